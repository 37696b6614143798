"""Cache keys and candidate identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wane.functions.text import strip


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def evidence_text(docstring: Column, warning: Column, replacement: Column) -> Column:
    return F.concat_ws("|", _text(docstring), _text(warning), _text(replacement))


def cache_key(model, version, call_text, api, evidence, *context: Column) -> Column:
    """SHA-256 over the stripped parts.

    Five parts give the published key. Passing ``context`` (mode, enclosing code)
    keeps verdicts about different surroundings of the same line apart.
    """
    five = [strip(_text(c)) for c in (model, version, call_text, api, evidence)]
    return F.sha2(F.concat_ws(":", *five, *[F.sha2(_text(c), 256) for c in context]), 256)


def zero_shot_key(model: Column, line: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws(":", model, line.cast("string"), F.sha2(prompt, 256)), 256)


def candidate_id(sample: Column, tag: Column, idx: Column, line: Column, col: Column) -> Column:
    return F.concat_ws("_", sample, tag, *[c.cast("string") for c in (idx, line, col)])


def draw(seed: int, *ids: Column) -> Column:
    """Order key of a reproducible random draw; independent of partitioning."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids]), 256)
