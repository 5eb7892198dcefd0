"""Cross-site boilerplate lines, found by the spread of each line over distinct sites.

Each line is known by two 64-bit hashes. One aggregation builds a HyperLogLog sketch of the
sites for every line (partial sketches merge before and after the shuffle, so that a line on
a third of all documents reaches its task as one row from each mapper). Lines whose estimate
is clear of the threshold are decided by it; lines near the threshold get an exact distinct
count. A line on ``min_sites`` sites or more is boilerplate; its first occurrence (smallest
document, then position) stays and every other one goes, however long it is. Only a caller
that gives ``max_chars`` leaves longer lines alone.

Occurrences meet the suspected lines in joins that end in written tables: nothing needs the rows
of a line together there, so that a line on a quarter of all documents is split among tasks.

Defined results: lines split at ``\\n`` and compare without the spaces and controls 9 to 13
around them; blank lines are no lines. Null texts stay null, a null source is no site, empty
tables give empty results, repeated rows are treated alike, and other columns pass through;
a column that has the name of an added one is replaced, unless ``added`` gives other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SITES, LG_K = 12, 12
#: Six standard errors of a sketch of 2 ** LG_K registers.
NEAR = 6 * 1.04 / 2 ** (LG_K / 2)

_EDGE = "\x09\x0a\x0b\x0c\x0d\x20"
_LINE = ["h1", "h2"]


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGE))


def _lines(docs: DataFrame, text: str, doc_id: str, source: str, max_chars: int | None) -> DataFrame:
    """One row a line that may be boilerplate: document, text hash, position, two line hashes, site."""
    return (
        docs.select(
            F.col(doc_id).alias("doc"),
            F.xxhash64(F.col(text)).alias("body"),
            F.col(source).alias("site"),
            F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"),
        )
        .withColumn("line", _stripped(F.col("raw")))
        .where((F.col("line") != "") & (F.lit(True) if max_chars is None else F.length("line") <= max_chars))
        .select("doc", "body", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    )


def suspects(lines: DataFrame, min_sites: int, lg_k: int, near: float) -> DataFrame:
    """Hashes of the lines that may be on ``min_sites`` sites: where each occurs first, and whether its sketch is clear of the threshold."""
    spread = lines.groupBy(*_LINE).agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc", "body", "pos")).alias("first")
    )
    sites, margin = F.hll_sketch_estimate("sketch"), min_sites * near + 1
    return spread.where(sites >= min_sites - margin).select(*_LINE, "first", (sites > min_sites + margin).alias("clear"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int, near: float) -> DataFrame:
    """The occurrences of the lines on ``min_sites`` sites or more, and where each line occurs first."""
    found = written(suspects(lines, min_sites, lg_k, near), "line-suspects")
    seen = written(lines.join(found.hint("merge"), _LINE), "line-occurrences")
    unsure = seen.where("not clear")
    # One row a line and site from each mapper, whatever their number of occurrences.
    exact = unsure.groupBy(*_LINE, "site").agg(F.lit(1).alias("one")).groupBy(*_LINE).agg(F.count("site").alias("sites"))
    exact = written(exact.where(F.col("sites") >= min_sites).select(*_LINE), "line-exact")
    return seen.where("clear").unionByName(unsure.join(exact.hint("merge"), _LINE, "left_semi"))


def dedup_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    max_chars: int | None = None,
    lg_k: int = LG_K,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    added: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``; adds ``n_lines`` and ``n_removed``.

    The text crosses the network once, when the positions to cut come back to their document.
    """
    lines = _lines(docs, text, doc_id, source, max_chars)
    cut = (
        boilerplate(lines, min_sites, lg_k, NEAR)
        .where(~F.struct("doc", "body", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc", "body")
        .agg(F.collect_set("pos").alias("_ll_cut"))
        .select(F.col("doc").alias("_ll_doc"), F.col("body").alias("_ll_body"), "_ll_cut")
    )
    split = F.split(F.col(text), "\n", -1)
    cut_at = F.coalesce(F.col("_ll_cut"), F.array().cast("array<int>"))
    kept = F.when(
        F.size(cut_at) > 0,
        F.array_join(F.filter(split, lambda line, i: ~F.array_contains(cut_at, i)), "\n"),
    ).otherwise(F.col(text))
    n_lines = F.coalesce(F.size(F.filter(split, lambda line: _stripped(line) != "")).cast("long"), F.lit(0).cast("long"))
    columns = [c for c in docs.columns if c not in added]
    return (
        docs.select(*columns)
        .join(cut, F.col(doc_id).eqNullSafe(F.col("_ll_doc")) & (F.xxhash64(F.col(text)) == F.col("_ll_body")), "left")
        .select(
            *[kept.alias(c) if c == text else F.col(c) for c in columns],
            n_lines.alias(added[0]),
            F.size(cut_at).cast("long").alias(added[1]),
        )
    )
