"""Mixing sources to target weights by entropy balancing.

Among all mixes that take each source's target of words, and whose words come from
documents as long as the corpus's do (the mean of ln(1 + size) over words stays;
this moment gives way where it must), take the one of least relative entropy to the
corpus, no document more than MOST times. Its rates are exponentially tilted,

    rate = min(MOST, exp(dual of the source + dual of the moment * x)),
    x = ln(1 + size) - the corpus's mean,

so a mix that leans on sources of long documents takes the shorter ones of each
source more often. The convex dual

    sum(words * phi(exponent)) - sum(dual * target) + SOFT / 2 * all words * moment's dual ** 2,

with phi the exponential, continued as a line from ln MOST on, is minimised by
Newton's iterations. Gradient and Hessian are sums over all words, combined by
(source, size) and added up by source in one distributed aggregation an iteration;
the Hessian is an arrow (a diagonal of sources and the moment), so its Schur complement
leaves one unknown, for which one row comes to the driver. A step that does not lower
the dual is halved.

Rates are then rounded into whole copies: a document takes floor(rate) copies and one
more if its hash, set against the rest of its rate, lies below its source's threshold;
equal rows share the copies of all of them, to the nearest one. Thresholds come from
word histograms, refined once; last, single documents move by one copy where that
brings their source's sum nearer to its target.

Everything is a map-side combined sum over a narrow table of ids and sizes, so a hot
source costs no more than others. Texts are not shuffled: a document's copies follow
from its id, size and by-source tables; only rows that occur several times, one of
each, go through a shuffle.

Defined cases: null or word-less texts have size 0 and take 0; a null source is a
source of its own, the last in order; repeated rows each keep a row and share their
copies as evenly as can be; an empty table gives no rows; extra columns are ignored,
or kept where documents are copied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, materialise
from .words import pieces, word_counts

CYCLE = (5.0, 2.0, 1.0)
MOST = 3.0
BINS = 2048
#: How much the moment gives way, against the words of the corpus.
SOFT = 0.05
ROUNDS = 40
#: A row of a by-source table is under 100 bytes, so a broadcast one is under 10 MB.
BROADCAST_SOURCES = 100_000
#: Rows made of one at a time; a row that is taken more often is dealt out first.
RUN = 1000


def word_sizes(docs: DataFrame, *keep: str, name: str = "size", text: str = "text") -> DataFrame:
    """The columns ``keep`` and one more: words of the text (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            kept = [b.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(word_counts(b.column(text)), pa.int64())], [*keep, name])

    fields = [docs.schema[k] for k in keep]
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.LongType())]))


def cycle_weights(per: DataFrame) -> DataFrame:
    """Adds weight to (source, source_size): by code point, null last, 5, 2, 1, repeating.

    UTF-8 byte order, which Spark sorts by, is code point order. Sources are cut
    into at most 64 ranges, so that no task ranks all of them; only the ranges'
    counts come to the driver.
    """
    parts = max(1, min(int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64))
    ranged = materialise(per.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).withColumn("_part", F.spark_partition_id()), "sources")
    counts = _counts(ranged)
    lead = F.element_at(F.array(*[F.lit(sum(n for p, n in counts.items() if p < i)) for i in range(parts)]), F.col("_part") + 1)
    w = W.partitionBy("_part").orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(w) - 1 + lead
    weight = F.element_at(F.array(*[F.lit(x) for x in CYCLE]), (rank % len(CYCLE)).cast("int") + 1)
    return ranged.withColumn("weight", weight).drop("_part")


def _counts(ranged: DataFrame) -> dict[int, int]:
    """Sources by range, at most 64 rows."""
    return {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}


def allot(weighted: DataFrame, total: float | None = None, most: float = MOST) -> DataFrame:
    """Adds target: shares of the total by weight, none above ``most`` times its size.

    What sources at their bound leave is shared by the others by weight, again and
    again until none is above. The price per weight only rises, and each round is a
    sum over sources, so it ends after at most as many rounds as bounds are hit.
    """
    rows = weighted.agg(F.sum("source_size").cast("double").alias("all"), F.sum("weight").alias("w")).first()
    total = float(rows["all"] or 0.0) if total is None else total
    bound = most * F.col("source_size")
    price = total / rows["w"] if rows["w"] else 0.0
    while True:
        held = F.col("weight") * F.lit(price) >= bound
        x = weighted.agg(F.sum(F.when(held, bound)).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("free")).first()
        new = (total - (x["held"] or 0.0)) / x["free"] if x["free"] else price
        if new <= price:
            break
        price = new
    return weighted.withColumn("target", F.least(F.col("weight") * F.lit(price), bound).cast("double"))


def _nearness(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """By-source tables go to the rows while this one of all sources is small; beyond, rows are shuffled to them."""
    return F.broadcast if table.count() <= BROADCAST_SOURCES else lambda x: x.hint("merge")


def exponent(size: Column, centre: float, moment: float) -> Column:
    return F.lit(moment) * (F.log1p(size) - F.lit(centre))


def balance(cells: DataFrame, most: float = MOST, rounds: int = ROUNDS, soft: float = SOFT) -> tuple[DataFrame, float, float]:
    """(by source: _key, target, dual), centre and dual of the moment.

    cells(_key, size, words, target): the words of a source's documents of a size, and
    the source's target, above 0 and below ``most`` times its words where its rates are
    to be found; a source whose target is not has the rate ``most``, and no dual.
    """
    top = math.log(most)
    free = F.col("target") < most * F.col("all") * (1 - 1e-12)
    per = cells.groupBy("_key").agg(F.sum("words").cast("double").alias("all"), F.max("target").alias("target"))
    here = materialise(per.select("_key", "target", F.when(free, F.log(F.col("target") / F.col("all"))).alias("dual")), "duals")
    near = _nearness(here)
    known = cells.select("_key", "size", F.col("words").cast("double").alias("words"))
    sums = known.agg(F.sum("words").alias("n"), F.sum(F.col("words") * F.log1p("size")).alias("x")).first()
    n, tables = sums["n"] or 0.0, [here]
    centre, moment = round((sums["x"] or 0.0) / n, 9) if n else 0.0, 0.0
    own = F.col("dual").isNotNull()
    gap = F.when(own, F.col("g") - F.col("target")).otherwise(0.0)
    start, best, part = 0.0, None, 1.0
    while n and rounds:
        rounds -= 1
        u = F.when(own, F.col("dual") + exponent(F.col("size"), centre, moment)).otherwise(top)
        x = F.log1p("size") - F.lit(centre)
        slope = F.col("words") * F.exp(F.least(u, F.lit(top)))
        curve = F.when(own & (u < top), slope).otherwise(0.0)
        value = F.when(own, slope + F.col("words") * F.lit(most) * F.greatest(F.lit(0.0), u - top)).otherwise(0.0)
        got = known.join(near(here), "_key").groupBy("_key").agg(
            F.max("target").alias("target"), F.max("dual").alias("dual"), F.sum(slope).alias("g"), F.sum(curve).alias("h"), F.sum(curve * x).alias("c"),
            F.sum(slope * x).alias("m"), F.sum(curve * x * x).alias("mm"), F.sum(value).alias("v"), F.sum("words").alias("all"),
        )
        # Where all rates are at their bound there is no curvature to go by; the source's words bound it.
        got = materialise(got.withColumn("h", F.greatest("h", F.lit(1e-6) * F.col("all"))), "newton")
        tables.append(got)
        row = got.agg(
            F.sum(F.col("v") - F.coalesce("dual", F.lit(0.0)) * F.col("target")).alias("v"), F.sum("m").alias("m"), F.sum("mm").alias("mm"), F.sum(F.when(~own, F.col("m"))).alias("held"),
            F.sum(F.col("c") * F.col("c") / F.col("h")).alias("cc"), F.sum(F.col("c") * gap / F.col("h")).alias("cg"), F.max(F.abs(gap) / F.col("target")).alias("worst"),
        ).first()
        # A bound source's rates are fixed, and so is what they add to the moment.
        total = row["v"] + soft / 2 * n * moment * moment + moment * (row["held"] or 0.0)
        if best is not None and total > best + 1e-4 * part * down + 1e-13 * abs(best) and part > 1e-6:
            part /= 2
        else:
            off, best, part, start, kept = row["m"] + soft * n * moment, total, 1.0, moment, got
            if (row["worst"] or 0.0) < 1e-10 and abs(off) < 1e-10 * n:
                break
            ahead = -(off - row["cg"]) / max(row["mm"] + soft * n - row["cc"], 1e-6 * n)
            by = F.when(own, -(gap + F.col("c") * F.lit(ahead)) / F.col("h"))
            far = kept.agg(F.max(F.abs(by)).alias("far"), F.sum(gap * by).alias("down")).first()
            # A step is at most 2 in any dual.
            scale = min(1.0, 2 / max(abs(ahead), far["far"] or 0.0, 1e-300))
            down = scale * ((far["down"] or 0.0) + off * ahead)
        moment = start + part * scale * ahead
        here = kept.select("_key", "target", (F.col("dual") + F.lit(part * scale) * by).alias("dual"))
    found = materialise(here.select("_key", F.round("dual", 9).alias("dual")), "duals")
    discard(*tables)
    return found, centre, round(moment, 9)


def _bins(rows: DataFrame, plan: DataFrame, width: float) -> DataFrame:
    """Cuts [_lo, _lo + width) of _w into BINS; (_key, _lo, _need) move into the bin that the need ends in."""
    inside = rows.join(plan, "_key").where((F.col("_w") >= F.col("_lo")) & (F.col("_w") < F.col("_lo") + width))
    hist = inside.groupBy("_key", "_lo", "_need", F.floor((F.col("_w") - F.col("_lo")) / (width / BINS)).cast("int").alias("_bin")).agg(F.sum("size").alias("_t"))
    w = W.partitionBy("_key").orderBy("_bin")
    upto = hist.withColumn("_before", F.sum("_t").over(w) - F.col("_t")).where(F.col("_before") <= F.col("_need"))
    last = upto.groupBy("_key").agg(F.max(F.struct("_bin", "_before", "_lo", "_need")).alias("x"))
    return last.select("_key", (F.col("x._lo") + F.col("x._bin") * (width / BINS)).alias("_lo"), (F.col("x._need") - F.col("x._before")).alias("_need"))


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


class Mix:
    """How often every document is taken: by-source tables, and rows that occur several times.

    ``by`` names the columns of equal rows; doc_id, source and size are among them.
    """

    def __init__(self, sized: DataFrame, by: list[str], most: float = MOST, repairs: int = 3):
        self.most, self.by = most, by
        self.rows = rows = materialise(sized.groupBy(*by).agg(F.count("*").alias("count")).withColumn("_key", _key()), "mix")
        sums = rows.groupBy("_key", "source", "size").agg(F.sum(F.col("size") * F.col("count")).alias("words"))
        cells = materialise(sums, "cells")
        per = cycle_weights(cells.groupBy("source", "_key").agg(F.sum("words").alias("source_size")))
        plan = materialise(allot(per, most=most).select("_key", "source_size", "target"), "targets")
        self.near = near = _nearness(plan)
        aimed = cells.join(near(plan.select("_key", "target")), "_key").where("words > 0 and target > 0").select("_key", "size", "words", "target")
        duals, self.centre, self.moment = balance(materialise(aimed, "aimed"), most)
        self.plan = materialise(plan.join(duals.withColumn("_some", F.lit(True)), "_key", "left"), "plan")
        # By what whole copies and equal rows take, each source still needs so many words of single rows.
        planned = self._planned(rows)
        taken = F.when(F.col("count") > 1, F.col("_many")).otherwise(F.col("_whole")) * F.col("size")
        need = planned.groupBy("_key").agg(F.sum(taken).alias("_sum")).join(plan, "_key").select("_key", F.lit(0.0).alias("_lo"), F.greatest(F.lit(0.0), F.col("target") - F.col("_sum")).alias("_need"))
        need = materialise(need, "need")
        single = planned.where("count = 1 and _w < 1 and size > 0").select("_key", "_w", "size")
        cut = _bins(single, near(_bins(single, near(need), 1.0)), 1.0 / BINS)
        self.plan = materialise(self.plan.join(cut.select("_key", F.col("_lo").alias("_cut")), "_key", "left"), "plan")
        self.moves = self._repair(repairs)

    def _planned(self, rows: DataFrame) -> DataFrame:
        """Adds _rate, _whole (copies at least), _many (of all equal rows) and _w: what is set against the threshold."""
        x = rows.join(self.near(self.plan), "_key")
        tilted = F.exp(F.col("dual") + exponent(F.col("size"), self.centre, self.moment))
        rate = F.when(F.col("_some").isNull(), F.lit(0.0)).when(F.col("dual").isNull(), F.lit(self.most)).otherwise(F.least(F.lit(self.most), F.round(tilted, 9)))
        u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "size"), 11) / F.lit(float(1 << 53))
        x = x.withColumn("_rate", rate).withColumn("_u", u).withColumn("_whole", F.floor("_rate"))
        rest = F.col("_rate") - F.col("_whole")
        x = x.withColumn("_w", F.when(rest > 0, F.col("_u") / (F.col("_u") + rest)).otherwise(1.0))
        if "count" not in rows.columns:
            return x
        return x.withColumn("_many", F.col("count") * F.col("_whole") + F.floor(F.col("count") * rest + F.col("_u")))

    def _one(self) -> Column:
        return F.col("_whole") + ((F.col("_w") < 1) & (F.col("_w") < F.coalesce("_cut", F.lit(0.0)))).cast("bigint")

    def decided(self) -> DataFrame:
        """The rows with ``copies``: how often all equal ones together are taken."""
        return self._planned(self.rows).withColumn("copies", F.when(F.col("count") > 1, F.col("_many")).otherwise(self._one()))

    def _repair(self, repairs: int) -> DataFrame | None:
        """(_key, equal rows' columns, _d): by source, rows that move by one copy, each the one that brings the sum nearest to its target."""
        got = self.decided().select("_key", *self.by, "count", "copies", "target")
        off = materialise(got.groupBy("_key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_off")), "off")
        moves = None
        for _ in range(repairs):
            can = F.when(F.col("_off") > 0, F.col("copies") < self.most * F.col("count")).otherwise(F.col("copies") > 0)
            after = F.abs(F.abs("_off") - F.col("size"))
            tried = got.join(self.near(off), "_key").where((F.col("size") > 0) & can & (after < F.abs("_off")))
            if moves is not None:
                tried = tried.join(self.near(moves.drop("_d")), self._same(), "left_anti")
            best = tried.groupBy("_key", "_off").agg(F.min(F.struct(after.alias("a"), F.xxhash64("doc_id", "size").alias("u"), *self.by)).alias("b"))
            found = materialise(best.select("_key", *[F.col(f"b.{c}").alias(f"_m_{c}") for c in self.by], F.signum("_off").cast("bigint").alias("_d")), "moves")
            if found.isEmpty():
                break
            off = off.join(found.select("_key", (F.col("_d") * F.col("_m_size")).alias("_by")), "_key", "left").select("_key", (F.col("_off") - F.coalesce("_by", F.lit(0))).alias("_off"))
            moves = found.drop("_key") if moves is None else moves.unionByName(found.drop("_key"))
        return moves

    def _same(self) -> Column:
        out = F.lit(True)
        for c in self.by:
            out &= F.col(c).eqNullSafe(F.col(f"_m_{c}"))
        return out

    def moved(self, rows: DataFrame) -> DataFrame:
        """Adds the repairs to ``copies``."""
        if self.moves is None:
            return rows
        return rows.join(self.near(self.moves), self._same(), "left").withColumn("copies", F.col("copies") + F.coalesce("_d", F.lit(0)))


def _runs(rows: DataFrame, n: Column, first: str, last: str) -> DataFrame:
    """A row for each RUN of 1..n; where one has many, they are dealt out."""
    each = rows.withColumn(first, F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n, F.lit(RUN).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))).withColumn(last, F.least(n, F.col(first) + (RUN - 1)))
    return each.repartition(F.col(first), F.xxhash64(*[c for c, k in rows.dtypes if k == "bigint"]))


def mix_sources(docs: DataFrame, most: float = MOST, repairs: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, rate), one row per document row."""
    found = Mix(word_sizes(docs, "doc_id", "source"), ["doc_id", "source", "size"], most, repairs)
    got = found.moved(found.decided()).select("doc_id", "source", "size", "source_size", "target", "count", "copies", F.col("_rate").alias("rate"))
    one = got.where("count = 1").withColumn("own", F.col("copies"))
    many = _runs(got.where("count > 1"), F.col("count"), "_first", "_last").withColumn("_at", F.explode(F.sequence("_first", "_last")))
    # Equal rows share their copies as evenly as can be.
    share = F.floor(F.col("copies") / F.col("count")) + (F.col("_at") <= F.col("copies") % F.col("count")).cast("bigint")
    rows = one.unionByName(many.withColumn("own", share).drop("_first", "_last", "_at"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("own") * F.col("size")).cast("bigint").alias("taken"), F.col("own").cast("int").alias("copies"), "rate")


def copy_documents(docs: DataFrame, most: float = MOST, repairs: int = 3) -> DataFrame:
    """The documents, with all their columns, as often as the mix takes them."""
    columns, fields = docs.columns, [f"_countloom_{c}" for c in docs.columns]
    # Under names of our own, so that none clashes.
    own = docs.toDF(*fields)
    plain = [c for c, k in own.dtypes if "map<" not in k and "variant" not in k]
    own = own.select("*", F.col("_countloom_doc_id").cast("bigint").alias("doc_id"), F.col("_countloom_source").alias("source"), F.xxhash64(*plain).alias("_h"))
    by = ["doc_id", "source", "size", "_h"]
    found = Mix(word_sizes(own, "doc_id", "source", "_h", text="_countloom_text"), by, most, repairs)
    back = lambda df: df.select(*[F.col(f).alias(c) for f, c in zip(fields, columns, strict=True)])
    sized = word_sizes(own, *fields, "doc_id", "source", "_h", text="_countloom_text").withColumn("_key", _key())
    one = found.moved(found._planned(sized).withColumn("copies", found._one()))
    several = materialise(found.moved(found.decided()).where("count > 1").select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col("copies").alias("_copies")), "several")
    if not several.isEmpty():
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        near = _nearness(several)
        one = one.join(near(several), same, "left_anti")
        # One of each stands for all its equals.
        many = sized.join(near(several), same).dropDuplicates(by)
        dealt = _runs(many.where("_copies > 0"), F.col("_copies"), "_first", "_last").withColumn("_at", F.explode(F.sequence("_first", "_last")))
        return back(one.where("copies > 0").withColumn("_at", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))).unionByName(back(dealt))
    return back(one.where("copies > 0").withColumn("_at", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))))
