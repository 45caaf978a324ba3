"""Spans as array columns: extraction, overlap resolution, replacement, restoration.

A span is a struct (entity_type, start, end, text, engine, rule_id, priority,
ord) with half-open code-point offsets. All of it is built-in expressions, one
row a segment, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,start:int,end:int,text:string,engine:string,rule_id:string,priority:int,ord:int>"
SPANS = f"array<{SPAN}>"
ENGINES = {"regex": 0, "ner": 1}


def none() -> Column:
    return F.array().cast(SPANS)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds (or replaces) columns that are computed once a row, however often they are read.

    The optimizer merges projections and so copies an expression to each of its
    uses; it doesn't reach through a generator. One row in gives one row out.
    """
    names = [c for c in df.columns if c not in columns]
    one = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*names, F.explode(F.array(one)).alias("_pin")).select(*names, *(F.col(f"_pin.{n}").alias(n) for n in columns))


def found(text: Column, pattern: str) -> Column:
    """array<struct(start, end, text)> of a pattern's matches.

    Match offsets are the running lengths of the pieces between matches and the
    matches themselves. (?U) gives the character classes their Unicode meaning.
    """
    p = F.lit("(?U)" + pattern)
    pairs = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))
    kind = "struct<at:int,out:array<struct<start:int,end:int,text:string>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out")).cast(kind)

    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def located(text: Column, terms: Column) -> Column:
    """Every place of every term, overlapping ones too: array<struct(start, end, text)>."""

    def places(term: Column) -> Column:
        # The text is cut before every place: running lengths of the pieces are the places.
        quoted = F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
        sizes = F.transform(F.split(text, quoted, -1), F.length)
        first = F.when(F.startswith(text, term), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        inner = F.slice(sizes, 1, F.size(sizes) - 1)
        at = F.aggregate(inner, F.struct(F.lit(0).alias("n"), first.alias("at")), lambda acc, n: F.struct((acc["n"] + n).alias("n"), F.concat(acc["at"], F.array(acc["n"] + n)).alias("at")), lambda acc: acc["at"])
        return F.transform(at, lambda i: F.struct(i.alias("start"), (i + F.length(term)).alias("end"), term.alias("text")))

    return F.flatten(F.transform(F.filter(terms, lambda t: (t != "") & F.contains(text, t)), places))


def as_spans(places: Column, entity_type: str, engine: str, rule_id: str | None, priority: int) -> Column:
    return F.transform(
        places,
        lambda m: F.struct(
            F.lit(entity_type).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"),
            F.lit(engine).alias("engine"), F.lit(rule_id).cast("string").alias("rule_id"), F.lit(priority).alias("priority"), F.lit(0).alias("ord"),
        ),
    ).cast(SPANS)


def changed(span: Column, **new: Column) -> Column:
    names = ["entity_type", "start", "end", "text", "engine", "rule_id", "priority", "ord"]
    return F.struct(*((new[n] if n in new else span[n]).alias(n) for n in names)).cast(SPAN)


def numbered(spans: Column, first: Column | int = 0) -> Column:
    """Discovery order: the place in the array, from ``first``."""
    return F.transform(spans, lambda s, i: changed(s, ord=(i + first).cast("int")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart_from(spans: Column, others: Column) -> Column:
    """Interval anti-join: spans that meet none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: overlaps(s, o)))


def ranked(spans: Column) -> Column:
    """Longest first, then higher priority, pattern before model, earlier discovery."""
    rank = lambda s: F.when(s["engine"] == "regex", 0).when(s["engine"] == "ner", 1).otherwise(99)
    keyed = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("a"), (-s["priority"]).alias("b"), rank(s).alias("c"), s["ord"].alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"]).cast(SPANS)


def resolved(spans: Column) -> Column:
    """struct(kept by start, dropped in rank order): greedy, each against all kept before."""
    kind = f"struct<kept:{SPANS},dropped:{SPANS}>"
    empty = F.struct(F.array().alias("kept"), F.array().alias("dropped")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        hit = F.exists(acc["kept"], lambda k: overlaps(s, k))
        more = F.array(s)
        kept = F.when(hit, acc["kept"]).otherwise(F.concat(acc["kept"], more))
        dropped = F.when(hit, F.concat(acc["dropped"], more)).otherwise(acc["dropped"])
        return F.struct(kept.alias("kept"), dropped.alias("dropped")).cast(kind)

    return F.aggregate(ranked(spans), empty, step, lambda a: F.struct(by_start(a["kept"]).alias("kept"), a["dropped"].alias("dropped")))


def by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["ord"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"]).cast(SPANS)


OCCURRENCE = "struct<entity_type:string,original:string,replacement:string,engine:string,original_start:int,original_end:int,redacted_start:int,redacted_end:int>"


def replaced(text: Column, spans: Column, label) -> Column:
    """struct(text, occurrences): spans by start replaced left to right, those that overlap skipped.

    label: span -> replacement column.
    """
    kind = f"struct<at:int,size:int,pieces:array<string>,occ:array<{OCCURRENCE}>>"
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().alias("pieces"), F.array().alias("occ")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        new = label(s)
        gap = s["start"] - acc["at"]
        begin = acc["size"] + gap
        end = begin + F.length(new)
        pieces = F.concat(acc["pieces"], F.array(F.substring(text, acc["at"] + 1, gap), new))
        occ = F.struct(
            s["entity_type"].alias("entity_type"), s["text"].alias("original"), new.alias("replacement"), s["engine"].alias("engine"),
            s["start"].alias("original_start"), s["end"].alias("original_end"), begin.alias("redacted_start"), end.alias("redacted_end"),
        )
        done = F.struct(s["end"].alias("at"), end.alias("size"), pieces.alias("pieces"), F.concat(acc["occ"], F.array(occ)).alias("occ")).cast(kind)
        return F.when(gap < 0, acc).otherwise(done)

    def finish(acc: Column) -> Column:
        rest = F.substring(text, acc["at"] + 1, F.length(text))
        return F.struct(F.concat(F.array_join(acc["pieces"], ""), rest).alias("text"), acc["occ"].alias("occurrences"))

    return F.aggregate(spans, empty, step, finish)


def restored(redacted: Column, occurrences: Column) -> Column:
    """The source text, by position: replacements that look alike stay apart."""
    kind = "struct<at:int,pieces:array<string>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().alias("pieces")).cast(kind)
    ordered = F.array_sort(F.transform(occurrences, lambda o: F.struct(o["redacted_start"].alias("a"), o["redacted_end"].alias("b"), o["original"].alias("o"))))

    def step(acc: Column, o: Column) -> Column:
        gap = F.substring(redacted, acc["at"] + 1, o["a"] - acc["at"])
        return F.struct(o["b"].alias("at"), F.concat(acc["pieces"], F.array(gap, o["o"])).alias("pieces")).cast(kind)

    return F.aggregate(ordered, empty, step, lambda acc: F.concat(F.array_join(acc["pieces"], ""), F.substring(redacted, acc["at"] + 1, F.length(redacted))))
