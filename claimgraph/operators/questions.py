"""Questions as typed constraints: literals, a file, and one of three shapes (relation, property, identifier).

A question that fits no shape, or fits one without naming what it is about, is said to; it is never read as another."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from claimgraph.functions.vocabulary import PROPERTY_WORDS

# What counts as a name, a literal, a file, a question; relations and properties by their wording, in order.
NAME = re.compile(r"\b(?:[A-Za-z_][A-Za-z0-9_]*\.)*[A-Za-z_][A-Za-z0-9_]*\b")
NUMBER = re.compile(r"\b\d+(?:\.\d+)?\b")
QUOTED = re.compile(r"'([^']+)'|\"([^\"]+)\"")
FILE = re.compile(r"(?<![\w/])((?:[A-Za-z_][\w.-]*/)*[A-Za-z_][\w.-]*\.(?:py|rst|md|toml|txt|html))\b")
ASKS = re.compile(r"\b(what|which|why|how|where|when|does|do|is|are|can)\b", re.I)
RELATIONS = [
    (r"\bdoes\s+([\w.]+)\s+(?:call|invoke)\s+([\w.]+)", "CALLS"),
    (r"\bwhat\s+does\s+([\w.]+)\s+call\b", "CALLS"),
    (r"\bwhich\s+method\s+of\s+([\w.]+)\s+calls?\s+([\w.]+)", "CALLS"),
    (r"\bdoes\s+([\w.]+)\s+(?:extend|subclass|inherit\s+from)\s+([\w.]+)", "EXTENDS"),
    (r"\bwhich\s+class\s+does\s+([\w.]+)\s+extend\b", "EXTENDS"),
    (r"\bwhat\s+does\s+([\w.]+)\s+inherit\s+from\b", "EXTENDS"),
    (r"\bdoes\s+([\w.]+)\s+import\s+([\w.]+)", "IMPORTS"),
    (r"\bwhat\s+does\s+([\w.]+)\s+import\b", "IMPORTS"),
    (r"\bwhat\s+does\s+([\w.]+)\s+contain\b", "CONTAINS"),
]
PROPERTIES = [
    r"what\s+(?:is|are)\s+the\s+(?P<property>[\w_ ]+?)\s+(?:of|for)\s+(?P<entity>[\w.]+)",
    r"(?P<entity>[\w.]+)'s\s+(?P<property>[\w_]+)",
    r"what\s+(?:is|are)\s+the\s+default\s+(?P<property>[\w_ ]+?)\s+(?:of|for|in)\s+(?P<entity>[\w.]+)",
]
NO_ENTITY = frozenset("the a an it this that default value class module method function file library attribute property".split())
_RELATIONS = [(re.compile(p, re.I), kind) for p, kind in RELATIONS]
_PROPERTIES = [re.compile(p, re.I) for p in PROPERTIES]
FIELDS = "status string, shape string, subject string, predicate string, property string, object string, literals array<string>, scope string"
_ARROW = pa.schema([("qid", pa.string()), ("question", pa.string()), *((c, pa.string()) for c in ("status", "shape", "subject", "predicate", "property", "object")), ("literals", pa.list_(pa.string())), ("scope", pa.string())])


def constraints(question: str) -> dict:
    """FIELDS of a question; status is PARSED, PARTIAL, AMBIGUOUS or UNPARSEABLE."""
    literals = {*NUMBER.findall(question), *(a or b for a, b in QUOTED.findall(question))}
    file = FILE.search(question)
    out = dict.fromkeys(("subject", "predicate", "property", "object")) | {"literals": sorted(literals), "scope": file[1] if file else None}

    def code(name: str) -> bool:
        shaped = any(map(str.isupper, name)) or "_" in name or "." in name
        return shaped and name.lower() not in NO_ENTITY and not FILE.fullmatch(name) and not (file and name in file[1])

    names = [n for n in NAME.findall(question) if code(n)]
    for pattern, kind in _RELATIONS:
        if m := pattern.search(question):
            ends = [g.strip(".,?") for g in m.groups()]
            return out | {"status": "PARSED", "shape": "relation", "predicate": kind, "subject": ends[0], "object": ends[1] if len(ends) > 1 else None}
    for pattern in _PROPERTIES:
        if m := pattern.search(question):
            words, entity = m["property"].strip().lower(), m["entity"].strip(".,?")
            subject = entity if entity and entity.lower() not in NO_ENTITY else names[0] if names else None
            wanted = words.replace(" ", "_") or None
            # The first part between underscores, as the words were written, tells the predicate.
            return out | {"status": "PARSED" if subject and wanted else "PARTIAL", "shape": "property", "property": wanted, "subject": subject, "predicate": PROPERTY_WORDS.get(words.split("_")[0])}
    if not names:
        return out | {"status": "UNPARSEABLE", "shape": "unparsed"}
    if ASKS.search(question):
        return out | {"status": "PARTIAL", "shape": "interrogative_unmapped", "subject": names[0]}
    return out | {"status": "AMBIGUOUS" if len(set(names)) > 1 else "PARSED", "shape": "identifier", "subject": names[0]}


def parse(questions: DataFrame) -> DataFrame:
    """(qid, question) with FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"qid": q, "question": t, **constraints(t or "")} for q, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return questions.selectExpr("cast(qid as string) qid", "question").mapInArrow(run, f"qid string, question string, {FIELDS}")
