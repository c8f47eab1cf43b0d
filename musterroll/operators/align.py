"""Match the headers of each file to contract fields.

``headers`` is ``file, pos, header``: one row per header cell, so small next
to the data.  Scores come from an expression over literal spellings, not from
a join with a table of them: every header is scored where it is, without a
shuffle and without pairs.  Groups are single files, bounded by their width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll import fixed_values as V
from musterroll.contract import BY_NAME, CONTRACT, NAMES, REQUIRED, Field
from musterroll.functions import text as X
from musterroll.runtime import one_row_each


def headers_of(header_rows: DataFrame) -> DataFrame:
    """One row per header cell of ``file, cells``."""
    return header_rows.select("file", F.posexplode("cells").alias("pos", "raw")).select(
        "file", "pos", X.strip(F.coalesce("raw", F.lit(""))).alias("header")
    )


def header_lists(header_rows: DataFrame) -> DataFrame:
    """The header row of each file as one array."""
    return header_rows.select("file", F.transform("cells", lambda c: X.strip(F.coalesce(c, F.lit("")))).alias("headers"))


def _unstarred(header: Column) -> Column:
    return F.regexp_replace(header, r"\*+\z", "")


def header_norm(header: Column) -> Column:
    """Trim, drop closing stars, lower, and make separators one blank."""
    bare = F.lower(_unstarred(X.strip(header)))
    return X.strip(F.regexp_replace(bare, rf"[_\-{X.BLANK}]+", " "))


def _norm_literal(spelling: str) -> str:
    out = spelling.strip().rstrip("*").lower()
    for sep in "_-\t\n":
        out = out.replace(sep, " ")
    return " ".join(out.split())


def _known(field: Field) -> list[str]:
    return [_norm_literal(s) for s in (field.header, *field.spellings)]


def _field_case(pairs: list[tuple[Column, Field]]) -> Column:
    out = None
    for cond, field in pairs:
        out = F.when(cond, field.name) if out is None else out.when(cond, field.name)
    return out


def match_exact(headers: DataFrame) -> DataFrame:
    """The header equal to a field's: same text, else unstarred, else any case.

    Per field the best tier wins, then the leftmost header.
    """
    low = F.lower(_unstarred(F.col("header")))
    field = _field_case([(low == f.label.lower(), f) for f in CONTRACT])
    exact = F.element_at(F.create_map(*[x for f in CONTRACT for x in (F.lit(f.name), F.lit(f.header))]), F.col("field"))
    tier = F.when(F.col("header") == exact, 1).when(_unstarred(F.col("header")) == _unstarred(exact), 2).otherwise(3)
    return (
        headers.filter(F.col("header") != "")
        .withColumn("field", field)
        .filter(F.col("field").isNotNull())
        .groupBy("file", "field")
        .agg(F.min(F.struct(tier.alias("tier"), F.col("pos"), F.col("header"))).alias("best"))
        .select("file", "field", "best.header", "best.tier", "best.pos")
    )


def match_unmatched(headers: DataFrame, exact: DataFrame) -> DataFrame:
    return headers.filter(F.col("header") != "").join(exact.select("file", "header"), ["file", "header"], "left_anti")


def _spellings_literal() -> Column:
    """The contract's known spellings as one constant array of structs."""

    def entry(f: Field) -> Column:
        known = list(dict.fromkeys(_known(f)))
        bags = list(dict.fromkeys(frozenset(k.split()) for k in known))
        return F.struct(
            F.lit(f.pos).alias("field_pos"),
            F.lit(f.name).alias("field"),
            F.array(*[F.lit(k) for k in known]).alias("known"),
            F.array(*[F.array(*[F.lit(w) for w in sorted(b)]) for b in bags]).alias("bags"),
        )

    return F.array(*[entry(f) for f in CONTRACT])


def _score(entry: Column, norm: Column, words: Column) -> Column:
    part = F.get(F.filter(entry.known, lambda k: k.contains(norm) | norm.contains(k)), F.lit(0))
    ratio = F.least(F.length(norm), F.length(part)) / F.greatest(F.length(norm), F.length(part)) * 0.8
    share = lambda bag: F.size(F.array_intersect(words, bag)) / F.size(F.array_union(words, bag)) * 0.6
    overlap = F.array_max(F.transform(entry.bags, share))
    return (
        F.when(F.array_contains(entry.known, norm), F.lit(1.0))
        .when(part.isNotNull(), ratio)
        .when(F.size(words) > 0, overlap)
        .otherwise(F.lit(0.0))
    )


def match_score(headers: DataFrame) -> DataFrame:
    """Score of each header against each field: ``file, pos, header, field_pos, field, score``.

    1 for a known spelling; else 0.8 times the length ratio of the first known
    spelling that contains it or is part of it; else 0.6 times the best share
    of common words.
    """
    staged = headers.withColumn("_norm", header_norm(F.col("header"))).withColumn(
        "_words", F.array_distinct(F.filter(F.split("_norm", " "), lambda w: w != ""))
    )
    scores = F.transform(
        _spellings_literal(),
        lambda f: F.struct(f.field_pos.alias("field_pos"), f.field.alias("field"), _score(f, F.col("_norm"), F.col("_words")).alias("score")),
    )
    return one_row_each(staged, ["file", "pos", "header"], scores, "s").select("file", "pos", "header", "s.*")


def match_best(scores: DataFrame, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Best field per header; equal scores go to the earlier field."""
    ranked = F.struct(F.col("score"), (-F.col("field_pos")).alias("_order"), F.col("field"))
    return (
        scores.filter((F.col("header") != "") & (F.col("score") >= min_confidence))
        .groupBy("file", "header")
        .agg(F.max(ranked).alias("best"))
        .select("file", "header", "best.field", "best.score")
    )


def match_conflict(best: DataFrame, exact: DataFrame) -> DataFrame:
    """Scored matches whose field no exact header has taken."""
    return best.join(exact.select("file", "field"), ["file", "field"], "left_anti")


def decide_scored(scored: DataFrame, accept: bool = True, decisions: DataFrame | None = None) -> DataFrame:
    """Keep scored matches of files that accept them (``file, accept``)."""
    if decisions is None:
        return scored if accept else scored.filter(F.lit(False))
    joined = scored.join(decisions.select("file", F.col("accept").alias("_ok")), "file", "left")
    return joined.filter(F.coalesce("_ok", F.lit(accept))).drop("_ok")


def match_manual(headers: DataFrame, mapping: DataFrame, overrides: DataFrame) -> DataFrame:
    """Given matches (``file, header, field``) for leftover headers and free fields."""
    left = headers.filter(F.col("header") != "").groupBy("file", "header").agg(F.min("pos").alias("pos"))
    left = left.join(mapping.select("file", "header"), ["file", "header"], "left_anti")
    chosen = overrides.filter(F.col("field").isin(*NAMES)).join(left, ["file", "header"])
    free = chosen.join(mapping.select("file", "field"), ["file", "field"], "left_anti")
    # A field taken by an earlier header is no longer offered for later ones.
    first = free.groupBy("file", "field").agg(F.min(F.struct("pos", "header")).alias("first"))
    return first.select("file", "first.header", "field")


def combine(exact: DataFrame, scored: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``file, header, field, how, score`` of all kinds of match."""
    out = exact.select("file", "header", "field", F.lit("exact").alias("how"), F.lit(1.0).alias("score")).unionByName(
        scored.select("file", "header", "field", F.lit("scored").alias("how"), "score")
    )
    if manual is not None:
        out = out.unionByName(
            manual.select("file", "header", "field", F.lit("manual").alias("how"), F.lit(None).cast("double").alias("score"))
        )
    return out


def field_positions(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per file with the cell position of each field, in columns ``p_<field>``.

    Where several headers map to one field the rightmost counts.
    """
    placed = headers.join(mapping.select("file", "header", "field"), ["file", "header"], "left")
    return placed.groupBy("file").agg(
        F.max("pos").alias("_last_pos"),
        *[F.max(F.when(F.col("field") == n, F.col("pos"))).alias(f"p_{n}") for n in NAMES],
    ).withColumn("width", F.col("_last_pos") + 1).drop("_last_pos")


def take_fields(rows: DataFrame) -> DataFrame:
    """Contract columns from ``cells`` and ``p_<field>``; null where absent."""
    keep = [c for c in rows.columns if c != "cells" and not c.startswith("p_")]
    return rows.select(*keep, *[F.get("cells", F.col(f"p_{n}")).alias(n) for n in NAMES])


def missing_fields(positions: DataFrame, required: bool) -> DataFrame:
    """``file, field_pos, field, label`` of fields without a header."""
    wanted = [f for f in CONTRACT if f.required == required]
    entries = F.array(
        *[
            F.when(
                F.col(f"p_{f.name}").isNull(),
                F.struct(F.lit(f.pos).alias("field_pos"), F.lit(f.name).alias("field"), F.lit(f.label).alias("label")),
            )
            for f in wanted
        ]
    )
    return one_row_each(positions, ["file"], entries, "m").select("file", "m.*")


def missing_default(positions: DataFrame, defaults: dict[str, str], decisions: DataFrame | None = None) -> DataFrame:
    """Per file: the first required field that is absent and has no default.

    ``unfilled`` is its label, or null where the file can go on; ``defaulted``
    lists the fields that will be filled by a constant.  A default that
    ``decisions`` (``file, field, accept``) declines is none for that file.
    """
    known = {**V.MISSING_FIELD_DEFAULTS, **{k: v for k, v in defaults.items() if v}}
    none = F.array().cast("array<string>")
    if decisions is None:
        positions = positions.withColumn("_declined", none)
    else:
        declined = decisions.filter(~F.col("accept")).groupBy("file").agg(F.collect_set("field").alias("_declined"))
        positions = positions.join(declined, "file", "left").withColumn("_declined", F.coalesce("_declined", none))
    absent = lambda f: F.col(f"p_{f.name}").isNull()
    refused = lambda f: F.array_contains("_declined", f.name) if f.name in known else F.lit(True)
    lost = [F.when(absent(f) & refused(f), F.lit(f.label)) for f in REQUIRED]
    filled = [F.when(absent(BY_NAME[n]) & ~F.array_contains("_declined", n), F.lit(n)) for n in NAMES if n in known]
    return positions.select(
        "file",
        F.coalesce(*lost).alias("unfilled"),
        F.array_join(F.array(*filled), ",").alias("defaulted"),
    )


def with_missing_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Fill fields whose header is absent (needs the ``p_`` columns)."""
    known = {**V.MISSING_FIELD_DEFAULTS, **{k: v for k, v in defaults.items() if v}}
    return rows.withColumns(
        {n: F.when(F.col(f"p_{n}").isNull(), F.lit(v)).otherwise(F.col(n)) for n, v in known.items()}
    )


def open_choices(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Leftover headers, each with the fields still free in its file.

    Free fields come required first, then by label; at most twenty, so they
    travel as one array per file.
    """
    ordered = sorted(CONTRACT, key=lambda f: (not f.required, f.label + (" [required]" if f.required else "")))
    taken = mapping.groupBy("file").agg(F.collect_set("field").alias("taken"))
    left = (
        headers.filter(F.col("header") != "")
        .select("file", "header")
        .distinct()
        .join(mapping.select("file", "header"), ["file", "header"], "left_anti")
        .join(taken, "file", "left")
    )
    free = F.filter(
        F.array(*[F.lit(f.name) for f in ordered]),
        lambda n: ~F.array_contains(F.coalesce("taken", F.array().cast("array<string>")), n),
    )
    return left.select("file", "header", free.alias("choices"))


def _likeness(target: str, candidate: Column) -> Column:
    """Likeness of a candidate header to a wanted one, 0..100."""
    low = F.lower(X.strip(candidate))
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    chars = F.array_distinct(F.split(low, ""))
    want_words = F.array(*[F.lit(w) for w in sorted(set(target.split()))])
    want_chars = F.array(*[F.lit(c) for c in sorted(set(target))])
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    by_word = F.when(low == target, 100.0).otherwise(share(want_words, words) * 50)
    by_part = F.when(low.contains(target) | F.lit(target).contains(low), 30.0).otherwise(0.0)
    by_char = share(want_chars, chars) * 20
    return F.greatest(by_word, by_part, by_char)


def suggest_headers(header_lists: DataFrame, missing: DataFrame, k: int = 3, at_least: float = 15.0) -> DataFrame:
    """Up to ``k`` headers of the file that look most like a missing field's.

    ``header_lists`` is ``file, headers`` (the header row as one array).  The
    candidates are ranked inside that array; equal scores keep their order.
    """

    def ranked(field: Field) -> Column:
        target = field.label.lower().strip()
        scored = F.transform(
            "headers",
            lambda h, i: F.struct((-_likeness(target, h)).alias("order"), i.alias("pos"), h.alias("header")),
        )
        near = F.filter(scored, lambda s: (s.header != "") & (s.order <= -at_least))
        return F.transform(F.slice(F.array_sort(near), 1, k), lambda s: s.header)

    wanted = missing.join(header_lists, "file")
    out = None
    for f in CONTRACT:
        cond = F.col("field") == f.name
        out = F.when(cond, ranked(f)) if out is None else out.when(cond, ranked(f))
    carried = [c for c in ("label", "headers") if c in wanted.columns]
    return wanted.select("file", "field_pos", "field", *carried, out.alias("suggestions"))


def mapping_report(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every header with what it maps to and how sure that is, sorted."""
    labels = F.element_at(F.create_map(*[x for f in CONTRACT for x in (F.lit(f.name), F.lit(f.label))]), F.col("field"))
    named = headers.filter(F.col("header") != "").select("file", "header").distinct()
    share = F.when(F.col("score").isNotNull(), F.format_string("%.0f%%", F.col("score") * 100))
    return (
        named.join(mapping, ["file", "header"], "left")
        .select("file", "header", labels.alias("maps_to"), F.coalesce("how", F.lit("unmapped")).alias("how"), share.alias("confidence"))
        .orderBy("file", "header")
    )


def missing_report(positions: DataFrame, header_lists: DataFrame) -> DataFrame:
    """Missing required fields with the headers found and the nearest ones."""
    near = suggest_headers(header_lists, missing_fields(positions, required=True))
    found = F.array_join(F.filter("headers", lambda h: h != ""), ", ")
    return near.select("file", "field_pos", "label", F.array_join("suggestions", ", ").alias("suggestions"), found.alias("found"))
