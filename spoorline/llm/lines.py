"""Removal of lines that many sites share, by HyperLogLog sketches (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, fresh

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: A line of more words is long: whole passages, which rarely repeat by chance. ``LONG_LIMITS`` are its (sites, documents).
LONG_WORDS, LONG_LIMITS = 50, (8, 12)
#: Sketch size (2^12 registers, 1.6 % standard error); estimates within a quarter of the limit are counted exactly.
LG_K, NEAR = 12, 1.25
#: Flagged lines up to which all are broadcast, and of more the most frequent ones that are (about 100 bytes each).
BROADCAST_LINES, HOT_LINES = 100_000, 10_000


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", long_limits: tuple[int, int] | None = None) -> DataFrame:
    """``docs`` with columns n_lines, n_removed (long) and text without cross-site boilerplate.

    A line (split at \\n, compared byte for byte) on ``min_sites`` distinct sites or more is boilerplate; its
    first place, by smallest (doc_id, position), stays and all others go. Blank lines stay and count as lines.

    With ``long_limits`` (sites, documents) a line of over 50 words is boilerplate from so many distinct sites, or
    from so many distinct documents of whatever sites; a document without an id does not count.

    One aggregation gives each line hash (96 bits) a mergeable sketch of its sites. Lines whose estimate is
    within a quarter of the limit get an exact distinct count; others are decided by the sketch, whose error is
    far smaller. Up to 100,000 flagged lines are broadcast to their places; of more, the 10,000 most frequent are, and
    the rest, none of which has more than a ten-thousandth of the places, are joined by a shuffle. Each document's
    removed places then meet its text; what stays is picked by position, in time linear in the lines.

    A null site is no site. Null text stays null with 0 lines. Rows that repeat doc_id and text are cleaned
    alike, and only the first place of a line by (doc_id, position, text hash) keeps it. Columns named n_lines or
    n_removed are replaced; other columns stay, whatever their names. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    text = F.col("text").cast("string")
    key = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("th"), F.col(site).cast("string").alias("site"), F.split(text, "\n", -1).alias("parts"))
    key = key.select("d", "th", "site", F.posexplode("parts").alias("pos", "line"))
    wordy = F.when(F.length("line") > 2 * LONG_WORDS, F.size(F.split(F.trim("line"), r"\s+")) > LONG_WORDS).otherwise(False)
    line = key.where(F.trim("line") != "").select("d", "th", "site", "pos", F.xxhash64("line").alias("a"), F.hash("line").alias("b"), *([wordy.alias("long")] if long_limits else []))
    sketches, counts = [F.hll_sketch_agg("site", F.lit(LG_K)).alias("sk")], [F.count_distinct("site").alias("n")]
    ests = {"est": F.hll_sketch_estimate("sk")}
    if long_limits:
        own = F.when(F.col("long"), F.col("d"))
        sketches += [F.hll_sketch_agg(own, F.lit(LG_K)).alias("dk"), F.max("long").alias("long")]
        counts += [F.count_distinct(own).alias("m"), F.max("long").alias("long")]
        ests["docs"] = F.hll_sketch_estimate("dk")

    def reached(sites: str, documents: str, by: float = 1.0) -> Column:
        if not long_limits:
            return F.col(sites) >= min_sites * by
        many = (F.col(sites) >= min(min_sites, long_limits[0]) * by) | (F.col(documents) >= long_limits[1] * by)
        return F.when(F.col("long"), many).otherwise(F.col(sites) >= min_sites * by)

    seen = line.groupBy("a", "b").agg(*sketches, F.count(F.lit(1)).alias("places"), F.min(F.struct(F.col("d").isNull().alias("z"), "d", "pos", "th")).alias("first"))
    spread = scratch.write(seen.withColumns(ests).where(reached("est", "docs", 1 / NEAR)).drop("sk", "dk"))
    sure = reached("est", "docs", NEAR)
    near = spread.where(~sure)
    exact = line.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(*counts).where(reached("n", "m"))
    columns = ["a", "b", "first", "places"]
    flagged = scratch.write(spread.where(sure).select(*columns).unionByName(near.join(exact, ["a", "b"], "left_semi").select(*columns)))
    if flagged.count() <= BROADCAST_LINES:
        met = line.join(F.broadcast(flagged), ["a", "b"])
    else:
        hot = scratch.write(flagged.orderBy(F.desc("places"), "a", "b").limit(HOT_LINES))
        rest = flagged.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti")
        met = line.join(F.broadcast(hot), ["a", "b"]).unionByName(line.join(rest, ["a", "b"]))
    gone = met.where(~(F.col("d").eqNullSafe(F.col("first.d")) & (F.col("pos") == F.col("first.pos")) & (F.col("th") == F.col("first.th"))))
    d, th, out_at = fresh(docs, "d", "th", "gone")
    gone = gone.groupBy(F.col("d").alias(d), F.col("th").alias(th)).agg(F.collect_set("pos").alias(out_at))
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[d]) & (F.xxhash64(docs["text"].cast("string")) == gone[th]), "left").drop(gone[d], gone[th])
    parts = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), out_at)
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n"))[0]
    return out.withColumns(
        {
            "n_lines": F.coalesce(F.when(text.isNotNull(), F.size(parts)), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(out_at), F.lit(0)).cast("long"),
            "text": F.when(F.col(out_at).isNull(), F.col("text")).otherwise(kept),
        }
    ).drop(out_at)
