"""Checks that stop a run: holdout leaks, invalid questions, unfrozen schemas."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, functions as F

from .evaluation import QUESTION_TYPES

HOLDOUT_PHASE, SHOWN = 6, 10


class HoldoutLeak(RuntimeError):
    """Held-out papers where only development papers may be."""


class UnfrozenSchema(ValueError):
    """An extraction schema that isn't declared frozen, or is faulty."""


def is_stub(path: str) -> bool:
    return bool(re.search(r"stub", path.rsplit("/", 1)[-1], re.I))


def assert_no_holdout(used: DataFrame, holdout: DataFrame, phase: int) -> None:
    """Raises before the final phase if any used id (id) is held out; names ten at most."""
    if phase >= HOLDOUT_PHASE:
        return
    found = [r.id for r in used.join(holdout.select("id"), "id", "left_semi").select("id").distinct().orderBy("id").limit(SHOWN + 1).collect()]
    if found:
        raise HoldoutLeak("held-out papers in a development run: " + ", ".join(map(str, found[:SHOWN])) + (" and more" if len(found) > SHOWN else ""))


def question_faults(rows: DataFrame) -> DataFrame:
    """line_no and faults (an array, empty for a valid question) of ``read_jsonl`` rows."""
    q, spans = F.col("row"), F.coalesce(F.col("row.spans"), F.array())
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    refusal = q["type"] == "unanswerable"
    checks = [
        (q.isNull(), "not a JSON object"),
        (q.isNotNull() & blank(q["id"]), "no id"),
        (q.isNotNull() & blank(q["question"]), "no question"),
        (q.isNotNull() & ~F.coalesce(q["type"].isin(*QUESTION_TYPES), F.lit(False)), "unknown type"),
        (refusal & (F.size(spans) > 0), "unanswerable, yet with spans"),
        (q.isNotNull() & ~F.coalesce(refusal, F.lit(False)) & (F.size(spans) == 0), "answerable, yet without spans"),
        (F.exists(spans, lambda s: blank(s["paper_external_id"])), "a span without a paper"),
        (F.exists(spans, lambda s: F.coalesce(s["char_end"] < s["char_start"], F.lit(False))), "a span that ends before it begins"),
        (F.exists(spans, lambda s: F.coalesce(s["relevance"] <= 0, F.lit(False))), "a relevance that isn't positive"),
    ]
    named = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in checks])
    return rows.select("line_no", F.filter(named, lambda x: x.isNotNull()).alias("faults"))


def check_schema(spec: dict) -> dict:
    """A declared extraction schema, if it is frozen and sound."""
    faults = []
    if spec.get("status") != "frozen":
        faults.append("status isn't frozen")
    try:
        datetime.date.fromisoformat(str(spec.get("frozen_date")))
    except ValueError:
        faults.append("frozen_date isn't a date")
    fields = spec.get("fields") or []
    names = [f.get("name") for f in fields]
    if not fields:
        faults.append("no fields")
    faults += [f"field {n} occurs twice" for n in sorted({n for n in names if names.count(n) > 1}, key=str)]
    faults += [f"field {f.get('name')} has cardinality {f.get('cardinality')!r}" for f in fields if f.get("cardinality", "single") not in ("single", "multiple")]
    faults += [f"unknown default column {c}" for c in spec.get("comparison_table_default_columns", []) if c not in names]
    if faults:
        raise UnfrozenSchema("; ".join(faults))
    return spec


def load_schema(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as file:
        return check_schema(yaml.safe_load(file))
