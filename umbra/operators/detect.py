"""From texts to kept spans: pattern rules, dates, bank numbers, resolution, policy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import scanner as B
from ..functions import spans as S
from ..rules import BANK_CONTEXT, LABOR, RULES, TIME_PATTERN, Policy, Rule, scan_order

_DIGITS = r"\p{Nd}{6}"


def _gate(rule: Rule, text: Column, digits: Column) -> Column | None:
    """A cheap necessary condition, so that few rows pay for the pattern."""
    if rule.needs is None:
        return None
    kind, what = rule.needs
    if kind == "any":
        out = F.lit(False)
        for term in what.split("|"):
            out = out | F.contains(text, F.lit(term))
        return out
    like = F.rlike(text, F.lit(what))
    return digits & like if r"\p{Nd}" in what or what.startswith("[0-9]{") else like


def rule_spans(text: Column, rules: list[Rule] | None = None, digits: Column | None = None) -> Column:
    """All rules' spans in scan order, numbered by discovery."""
    digits = F.rlike(text, F.lit(_DIGITS)) if digits is None else digits
    parts = []
    for r in scan_order(rules):
        hits = S.as_spans(S.found(text, r.pattern), r.entity_type, "regex", r.rule_id, r.priority)
        gate = _gate(r, text, digits)
        parts.append(hits if gate is None else F.when(gate, hits).otherwise(S.none()))
    return S.numbered(F.flatten(F.array(*parts)))


#: What moves rows in a plan: its output is spread over tasks already.
_MOVES = re.compile(r"^[ :+-]*(Repartition|RebalancePartitions|Join|Aggregate|Window|Sort|Distinct|Deduplicate|GlobalLimit)", re.M)


def balanced(segments: DataFrame) -> DataFrame:
    """The rows over all cores, where the input has fewer splits than there are cores.

    Patterns cost far more than moving a small input; a large one has splits
    enough and stays where it is, as does one that was moved before.
    """
    if segments.isStreaming or _MOVES.search(segments._jdf.queryExecution().optimizedPlan().toString()):
        return segments
    cores = segments.sparkSession.sparkContext.defaultParallelism
    return segments.repartition(cores) if segments.rdd.getNumPartitions() < cores else segments


def _in_batches(rules: list[Rule]) -> bool:
    """Whether Python's ``re`` takes all the patterns; others are column expressions."""
    try:
        return all(re.compile(r.pattern) for r in rules)
    except re.error:
        return False


def _batched(detector: B.Detector, kind: str, text: Column, extra: Column | None = None) -> Column:
    """The detector over batches of texts in Python workers."""
    if extra is None:

        def alone(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ready = detector.prepare()
            yield from map(ready, batches)

        return F.arrow_udf(alone, kind)(text)

    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ready = detector.prepare()
        yield from (ready(*x) for x in batches)

    return F.arrow_udf(both, kind)(text, extra.cast(S.SPANS))


def with_rule_spans(segments: DataFrame, rules: list[Rule] | None = None, text: str = "text", off: frozenset[str] = frozenset(), name: str = "spans") -> DataFrame:
    """Adds ``spans`` (or ``name``), without those of the types in ``off``."""
    order = scan_order(rules)
    if _in_batches(order):
        return S.pinned(balanced(segments), **{name: _batched(B.Detector(order, off=off, plain=True), S.SPANS, F.col(text))})
    # The digit test is shared by the digit rules.
    out = S.pinned(balanced(segments), _digits=F.rlike(F.col(text), F.lit(_DIGITS)))
    spans = F.coalesce(rule_spans(F.col(text), rules, F.col("_digits")), S.none())
    return S.pinned(out, **{name: F.filter(spans, lambda s: ~s["entity_type"].isin(sorted(off))) if off else spans}).drop("_digits")


def time_spans(text: Column, spans: Column) -> Column:
    """``spans`` and date expressions, whose discovery follows all before."""
    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["ord"])), F.lit(-1))
    found = S.as_spans(S.found(text, TIME_PATTERN), "TIME", "regex", "time_profile", 80)
    gated = F.when(F.rlike(text, F.lit("[0-9]{4}")), found).otherwise(S.none())
    return F.concat(spans, S.numbered(gated, last + 1))


def free_numbers(text: Column, spans: Column) -> Column:
    """Numbers of 12 to 19 digits that meet no span, as account spans."""
    digits = S.as_spans(S.found(text, r"(?<!\d)\d{12,19}(?!\d)"), "BANK_ACCOUNT", "regex", "bank_account_context", 110)
    return F.when(F.rlike(text, F.lit(r"\p{Nd}{12}")), S.apart_from(digits, spans)).otherwise(S.none())


def near_bank_word(text: Column, s: Column, window: int = 30) -> Column:
    """Whether a bank word stands in or near a span."""
    start = F.greatest(F.lit(0), s["start"] - window)
    return F.rlike(F.substring(text, start + 1, s["end"] + window - start), F.lit(BANK_CONTEXT))


def without_first_years(text: Column, spans: Column) -> Column:
    """Drops amounts that are a year before 年, as in 2023元年."""
    return F.filter(
        spans,
        lambda s: ~((s["entity_type"] == "MONEY") & F.rlike(s["text"], F.lit("^(19|20)[0-9]{2}元$")) & (F.substring(text, s["end"] + 1, F.lit(1)) == "年")),
    )


def types_off(policy: Policy) -> frozenset[str]:
    """Types that the policy leaves: unknown ones are redacted."""
    return frozenset(t for t in (*policy.preserved, *policy.overrides) if not policy.redacts(t))


def types_kept(spans: Column, policy: Policy) -> Column:
    """The policy's spans."""
    off = sorted(types_off(policy))
    return F.filter(spans, lambda s: ~s["entity_type"].isin(off)) if off else spans


def without_short_addresses(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~((s["entity_type"] == "ADDRESS") & (F.length(s["text"]) <= 3) & ~F.rlike(s["text"], F.lit("[省市区县镇乡路街号村]"))))


DETECTED = ("bare_numbers", "spans", "kept", "dropped")
_KINDS = {**dict.fromkeys(DETECTED, S.SPANS), "redacted_text": "string", "occurrences": f"array<{S.OCCURRENCE}>", "n_entities": "int"}


def detect(segments: DataFrame, policy: Policy = LABOR, rules: list[Rule] | None = None, extra: Column | None = None, text: str = "text", wanted: tuple[str, ...] = DETECTED, labels: dict[str, str] | None = None) -> DataFrame:
    """Adds kept (by start, policy applied), dropped, bare_numbers, spans (all, before resolution).

    extra: spans of other engines, to be resolved with the rules'. A null text
    has no spans. Each text is gone through once; nothing shuffles. wanted: the
    columns to add, in this order; with labels also redacted_text, occurrences, n_entities.
    """
    order = scan_order(rules)
    if not _in_batches(order):
        out = _detected_by_columns(segments, policy, rules, extra, text)
        if labels is not None:
            out = S.pinned(out, _x=S.replaced(F.col(text), F.col("kept"), lambda s: M.mapped(labels, s["entity_type"], F.concat(F.lit("【"), s["entity_type"], F.lit("】")))))
            pairs = F.transform("_x.occurrences", lambda o: F.struct(o["entity_type"], o["original"]))
            out = out.withColumns({"redacted_text": F.col("_x.text"), "occurrences": F.col("_x.occurrences"), "n_entities": F.size(F.array_distinct(pairs))})
        return out.select(*(c for c in segments.columns if c not in wanted), *wanted)
    detector = B.Detector(order, policy.redacts("TIME"), types_off(policy), labels, tuple(wanted))
    kind = "struct<" + ",".join(f"{c}:{_KINDS[c]}" for c in wanted) + ">"
    out = S.pinned(balanced(segments), _d=_batched(detector, kind, F.col(text), extra))
    return out.select(*(c for c in segments.columns if c not in wanted), *(F.col(f"_d.{c}").alias(c) for c in wanted))


def _detected_by_columns(segments: DataFrame, policy: Policy, rules: list[Rule] | None, extra: Column | None, text: str) -> DataFrame:
    """``detect`` as column expressions, for patterns that only Java takes. Each step is computed once a row."""
    t = F.col(text)
    out = with_rule_spans(segments, rules, text)
    if extra is not None:
        out = S.pinned(out, spans=F.concat("spans", F.coalesce(extra, S.none())))
    if policy.redacts("TIME"):
        out = S.pinned(out, spans=F.coalesce(time_spans(t, F.col("spans")), F.col("spans")))
    free = F.coalesce(free_numbers(t, F.col("spans")), S.none())
    out = S.pinned(out, _free=free)
    out = S.pinned(out, _accounts=F.filter("_free", lambda s: near_bank_word(t, s)), bare_numbers=F.filter("_free", lambda s: ~near_bank_word(t, s)))
    last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["ord"])), F.lit(0))
    out = S.pinned(out, spans=without_first_years(t, F.concat("spans", S.numbered(F.col("_accounts"), last + 1))))
    out = S.pinned(out, _r=S.resolved(F.col("spans")))
    return S.pinned(out, kept=types_kept(F.col("_r.kept"), policy), dropped=F.col("_r.dropped")).drop("_r", "_free", "_accounts")


def line_type(text: Column, rules: list[Rule] | None = None) -> Column:
    """Type of the foremost rule found in the text: higher priority first, then as listed; null for none."""
    listed = [r for r in (RULES if rules is None else rules) if r.enabled]
    return F.coalesce(*(F.when(F.rlike(text, F.lit("(?U)" + r.pattern)), r.entity_type) for r in sorted(listed, key=lambda r: -r.priority)), F.lit(None).cast("string"))
