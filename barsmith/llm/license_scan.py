"""Licence recognition by sentence rules.

A text is cut into sentences (at line ends and after ``. ; :``), each sentence is
normalised (lower case, words only, the article dropped), and known sentences become identifiers:
``SENTENCES`` maps a pattern to an identifier, which may take the version from
the text. What is left of a document is a short ordered sequence of identifiers.
``LICENCES`` then lists sequences in order of precedence: a rule matches where its
identifiers follow one another in the document (other known sentences may stand
between them only if the rule says ``...``); matched identifiers are used up, so a
longer licence text is not also reported as the shorter one it contains.

Results for odd input: null and empty texts have no sentences; an identifier that no
rule uses is reported in ``sentences`` with licence ``unknown``; every row stands
for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.frames import pick

#: (pattern on the normalised sentence, identifier); {1} takes the pattern's first group.
SENTENCES = tuple((re.compile(p), i) for p, i in (
    (r"\bgnu (?:lesser|library) general public licen[sc]e\b.*?\bversion (\d(?: \d)?)(?: .*)?\bany later version\b", "lgpl-{1}+"),
    (r"\bgnu affero general public licen[sc]e\b.*?\bversion (\d)(?: .*)?\bany later version\b", "agpl-{1}+"),
    (r"\bgnu general public licen[sc]e\b.*?\bversion (\d)(?: .*)?\bany later version\b", "gpl-{1}+"),
    (r"\bgnu (?:lesser|library) general public licen[sc]e\b.*?\bversion (\d(?: \d)?)\b", "lgpl-{1}"),
    (r"\bgnu affero general public licen[sc]e\b.*?\bversion (\d)\b", "agpl-{1}"),
    (r"\bgnu general public licen[sc]e\b.*?\bversion (\d)\b", "gpl-{1}"),
    (r"\bgnu (?:lesser|library) general public licen[sc]e\b", "lgpl"),
    (r"\bgnu affero general public licen[sc]e\b", "agpl"),
    (r"\bgnu general public licen[sc]e\b", "gpl"),
    (r"\bversion (\d(?: \d)?) of licen[sc]e or (?:at your option )?any later version\b", "version-{1}+"),
    (r"\bany later version\b", "or-later"),
    (r"\bapache licen[sc]e\b.*?\bversion (\d(?: \d)?)\b", "apache-{1}"),
    (r"\bapache licen[sc]e (\d(?: \d)?)\b", "apache-{1}"),
    (r"\bmozilla public licen[sc]e\b.*?\b(?:v|version) ?(\d(?: \d)?)\b", "mpl-{1}"),
    (r"\beclipse public licen[sc]e\b.*?\b(?:v|version) ?(\d(?: \d)?)\b", "epl-{1}"),
    (r"^permission is hereby granted free of charge to any person obtaining (?:a )?copy of this software\b", "mit-grant"),
    (r"^above copyright notice and this permission notice shall be included in all copies\b", "mit-notice"),
    (r"^software is provided as is without warranty of any kind\b", "mit-warranty"),
    (r"\b(?:under|by) (?:terms of )?mit licen[sc]e\b|^mit licen[sc]e$", "mit-name"),
    (r"^permission to use copy modify and or distribute this software for any purpose\b", "isc-grant"),
    (r"^redistribution and use in source and binary forms\b.*\bare permitted\b", "bsd-grant"),
    (r"\bredistributions of source code must retain\b.*\bcopyright notice\b", "bsd-source"),
    (r"\bredistributions in binary form must reproduce\b.*\bcopyright notice\b", "bsd-binary"),
    (r"\bneither name of\b.*\bused to endorse or promote products\b", "bsd-endorse"),
    (r"^this software is provided by\b.*\bas is\b", "bsd-warranty"),
    (r"\b(?:2|two) clause bsd\b|\bbsd 2 clause\b|\bsimplified bsd\b", "bsd2-name"),
    (r"\b(?:3|three) clause bsd\b|\bbsd 3 clause\b|\b(?:new|modified) bsd\b", "bsd3-name"),
    (r"\bcc by nc sa (\d(?: \d)?)\b|\bcreative commons attribution noncommercial sharealike (\d(?: \d)?)\b", "cc-by-nc-sa-{1}"),
    (r"\bcc by nc nd (\d(?: \d)?)\b|\bcreative commons attribution noncommercial noderivatives (\d(?: \d)?)\b", "cc-by-nc-nd-{1}"),
    (r"\bcc by nc (\d(?: \d)?)\b|\bcreative commons attribution noncommercial (\d(?: \d)?)\b", "cc-by-nc-{1}"),
    (r"\bcc by sa (\d(?: \d)?)\b|\bcreative commons attribution sharealike (\d(?: \d)?)\b", "cc-by-sa-{1}"),
    (r"\bcc by nd (\d(?: \d)?)\b|\bcreative commons attribution noderivatives (\d(?: \d)?)\b", "cc-by-nd-{1}"),
    (r"\bcc by (\d(?: \d)?)\b|\bcreative commons attribution (\d(?: \d)?)\b", "cc-by-{1}"),
    (r"\bcc0\b|\bcreative commons zero\b", "cc0"),
    (r"\b(?:in|into) public domain\b", "public-domain"),
    (r"\ball rights reserved\b", "all-rights-reserved"),
))
#: (identifiers in order, licence); the first rules take precedence, "..." lets other known sentences stand between.
LICENCES = (
    (("mit-grant", "...", "mit-notice", "...", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("gpl", "version-*+"), "GPL-*-or-later"), (("lgpl", "version-*+"), "LGPL-*-or-later"), (("agpl", "version-*+"), "AGPL-*-or-later"),
    (("gpl-*", "or-later"), "GPL-*-or-later"), (("lgpl-*", "or-later"), "LGPL-*-or-later"), (("agpl-*", "or-later"), "AGPL-*-or-later"),
    (("gpl-*+",), "GPL-*-or-later"), (("lgpl-*+",), "LGPL-*-or-later"), (("agpl-*+",), "AGPL-*-or-later"),
    (("gpl-*",), "GPL-*-only"), (("lgpl-*",), "LGPL-*-only"), (("agpl-*",), "AGPL-*-only"), (("gpl",), "GPL"), (("lgpl",), "LGPL"), (("agpl",), "AGPL"),
    (("apache-*",), "Apache-*"), (("mpl-*",), "MPL-*"), (("epl-*",), "EPL-*"), (("isc-grant",), "ISC"),
    (("mit-name",), "MIT"), (("bsd2-name",), "BSD-2-Clause"), (("bsd3-name",), "BSD-3-Clause"),
    (("cc-by-nc-sa-*",), "CC-BY-NC-SA-*"), (("cc-by-nc-nd-*",), "CC-BY-NC-ND-*"), (("cc-by-nc-*",), "CC-BY-NC-*"), (("cc-by-sa-*",), "CC-BY-SA-*"),
    (("cc-by-nd-*",), "CC-BY-ND-*"), (("cc-by-*",), "CC-BY-*"), (("cc0",), "CC0-1.0"), (("spdx-*",), "*"), (("public-domain",), "public-domain"),
)
#: No sentence pattern can match a text without one of these; single words, as line breaks and marks may part any two.
_HINT = re.compile(r"licen[sc]e|gnu|apache|mozilla|permission|redistribut|warranty|domain|reserved|creative|(?-i:[Cc][Cc](?:0|[^A-Za-z0-9]))|later|neither|provided|copyright|bsd", re.I)
_CUT = re.compile(r"\n\s*\n|(?<=[.;:])(?<!identifier:)(?=\s)|(?<!version)\n(?=\s*(?:[*#/-]|\d+[.)]\s|spdx|licen[sc]ed|released|this work|copyright(?!\s+notice)))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: A tag names its licence itself.
_TAG = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", re.I)


def normalised(sentence: str) -> str:
    return " ".join(w for w in _WORD.findall(sentence.lower()) if w != "the")


def identify(sentence: str) -> str | None:
    """Identifier of a sentence, or None if it is not a known one."""
    tag = _TAG.search(sentence)
    if tag:
        return f"spdx-{tag[1]}"
    sentence = normalised(sentence)
    for pattern, name in SENTENCES:
        m = pattern.search(sentence)
        if m:
            version = next((g for g in m.groups() if g), "") if m.groups() else ""
            return name.replace("{1}", version.replace(" ", "."))
    return None


def _bind(wanted: str, have: str, bound: str | None) -> tuple[bool, str | None]:
    if "*" not in wanted:
        return wanted == have, bound
    head, tail = wanted.split("*")
    got = have[len(head):len(have) - len(tail)] if have.startswith(head) and have.endswith(tail) else None
    if not got or head != "spdx-" and not re.fullmatch(r"\d+(?:\.\d+)?", got) or bound not in (None, got):
        return False, bound
    return True, got


def match(ids: list[str]) -> list[str]:
    """Licences of an ordered sequence of identifiers, in document order; those that no rule uses give ``unknown``."""
    left: list[str | None] = list(ids)
    found: list[tuple[int, str]] = []
    for rule, name in LICENCES:
        at = 0
        while at < len(left):
            used, bound, i, skip = [], None, at, False
            for wanted in rule:
                if wanted == "...":
                    skip = True
                    continue
                while i < len(left):
                    ok, bound = (False, bound) if left[i] is None else _bind(wanted, left[i], bound)
                    if ok or not skip:
                        break
                    i += 1
                if i >= len(left) or left[i] is None or not ok:
                    used = []
                    break
                used.append(i)
                i, skip = i + 1, False
            if used:
                found.append((used[0], name.replace("*", bound or "")))
                for u in used:
                    left[u] = None
            at += 1
    found += [(i, "unknown") for i, x in enumerate(left) if x is not None and x != "all-rights-reserved"]
    return list(dict.fromkeys(name for _, name in sorted(found)))


def licences_of(text: str) -> tuple[list[str], list[str]]:
    """(identifiers in order, licences) of one text."""
    if not _HINT.search(text):
        return [], []
    ids = [i for i in map(identify, _CUT.split(text)) if i]
    return ids, match(ids)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``sentences`` (identifiers in order), ``licences`` and ``n_licences``."""
    narrow = pick(docs, id=id_col, text=text_col)
    narrow = narrow.withColumn("text", F.col("text").cast("string"))
    texts = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [licences_of(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], texts), pa.array([r[1] for r in rows], texts),
                                              pa.array([len(r[1]) for r in rows], pa.int64())], ["id", "sentences", "licences", "n_licences"])

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, sentences array<string>, licences array<string>, n_licences long").withColumnRenamed("id", id_col)
