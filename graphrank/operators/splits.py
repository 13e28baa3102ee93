"""Leakage-free train, validation and test links with negatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrank.operators.negatives import sample_negatives
from graphrank.operators.ordering import stable_hash
from graphrank.plans.lineage import materialize
from graphrank.schemas import PREDICTED_RELATIONS

SPLITS = ("train", "val", "test")
#: Leading hexadecimal digits of a hash that are counted, pass by pass; what is above every hash.
_CUT_DIGITS, _ABOVE = (3, 6, 32), "~"


@dataclass(frozen=True)
class SplitOptions:
    seed: int = 13
    num_val: float | int = 0.1
    num_test: float | int = 0.1
    disjoint_train_ratio: float | int = 0.3
    relations: tuple[str, ...] = PREDICTED_RELATIONS
    negative_strategy: str = "random"
    train_negatives: float = 1.0
    eval_negatives: float = 10.0


def count_from_ratio(value: float | int, total: int) -> int:
    """Whole numbers are absolute, fractions are shares rounded half to even; both clamped."""
    wanted = value if isinstance(value, int) else round(total * value)
    return min(max(wanted, 0), max(total, 0))


def split_sizes(total: int, options: SplitOptions) -> dict[str, int]:
    """Rows of one relation per part. Training keeps at least one message edge where it can."""
    test = count_from_ratio(options.num_test, total)
    val = count_from_ratio(options.num_val, total - test)
    train = total - test - val
    supervision = count_from_ratio(options.disjoint_train_ratio, train)
    if train and supervision == 0 and options.disjoint_train_ratio > 0:
        supervision = 1
    if train > 1:
        supervision = min(supervision, train - 1)
    return {"test": test, "val": val, "train": supervision, "message": train - supervision}


def partition_links(links: DataFrame, options: SplitOptions) -> DataFrame:
    """Add ``split`` and ``role`` to distinct positive links ``(edge_type, src, dst)``.

    Links are in hash order per relation: the first are test, then validation,
    then training supervision, the rest messages. The order is over all tasks,
    so one relation with most of the links is cut like any other. Nothing is sorted: the hash at each
    cut is found by counting, and a link is compared with the three of its relation.
    """
    spark = links.sparkSession
    stored = materialize(links.select("edge_type", "src", "dst").where("edge_type is not null"))  # read by every count
    hashed = stored.withColumn("_digest", stable_hash(options.seed, F.col("edge_type"), F.col("src"), F.col("dst")))
    first = _counted(hashed, _CUT_DIGITS[0])
    places: dict[str, tuple[int, int, int]] = {}
    for edge_type, found in first.items():
        sizes = split_sizes(sum(found.values()), options)
        val = sizes["test"] + sizes["val"]
        places[edge_type] = (sizes["test"], val, val + sizes["train"])
    if not places:
        return hashed.select("edge_type", "src", "dst", F.lit("").alias("split"), F.lit("").alias("role")).limit(0)
    cuts = _cut_digests(hashed, places, first)
    columns = [f"_{part}_{what}" for part in ("test", "val", "train") for what in ("at", "ties")]
    limits = spark.createDataFrame(
        [(e, *[v for place in at for v in cuts[e, place][:2]]) for e, at in places.items()],
        ", ".join(["edge_type string", *[f"{c} {'string' if c.endswith('at') else 'bigint'}" for c in columns]]),
    )
    # links of one hash, as copies are, may lie on both sides of a cut: only those are numbered
    tied = sorted({cuts[e, place][0] for e, at in places.items() for place in at if cuts[e, place][2] > 1})
    among = Window.partitionBy("edge_type", "_digest").orderBy("src", "dst")
    hashed = hashed.where(~F.col("_digest").isin(tied)).withColumn("_tie", F.lit(0)).unionByName(
        hashed.where(F.col("_digest").isin(tied)).withColumn("_tie", F.row_number().over(among) - 1)
    ) if tied else hashed.withColumn("_tie", F.lit(0))

    def before(part: str) -> Column:
        at = F.col(f"_{part}_at")
        return (F.col("_digest") < at) | ((F.col("_digest") == at) & (F.col("_tie") < F.col(f"_{part}_ties")))

    # one row per relation
    marked = hashed.join(F.broadcast(limits), "edge_type")
    split = F.when(before("test"), "test").when(before("val"), "val").otherwise("train")
    role = F.when(before("train"), "supervision").otherwise("message")
    return marked.select("edge_type", "src", "dst", split.alias("split"), role.alias("role"))


def _counted(hashed: DataFrame, digits: int) -> dict[str, dict[str, int]]:
    """Rows per relation and first ``digits`` digits of the hash."""
    out: dict[str, dict[str, int]] = {}
    for r in hashed.groupBy("edge_type", F.substring("_digest", 1, digits).alias("_prefix")).agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r["edge_type"], {})[r["_prefix"]] = r["n"]
    return out


def _cut_digests(
    hashed: DataFrame, places: dict[str, tuple[int, ...]], first: dict[str, dict[str, int]]
) -> dict[tuple[str, int], tuple[str, int, int]]:
    """(hash, rows of that hash before the place, rows of that hash) of the row at each place in hash order.

    The digits of a hash are counted from the left, each time only among rows that begin like the one at a place: the
    driver holds at most 4 096 counts a place, and the last pass has a row in 16 million. A place past the end has a hash above all.
    """
    cuts: dict[tuple[str, int], tuple[str, int, int]] = {}
    counts = first
    for digits in _CUT_DIGITS:
        if digits != _CUT_DIGITS[0]:
            heads = sorted({f"{e}|{prefix}" for (e, _), (prefix, _, rows) in cuts.items() if rows})
            begin = F.concat_ws("|", "edge_type", F.substring("_digest", 1, len(heads[0].rsplit("|", 1)[1]))) if heads else F.lit("")
            counts = _counted(hashed.where(begin.isin(heads)), digits) if heads else {}
        for e, at in places.items():
            for place in at:
                prefix, rest, rows = cuts.get((e, place), ("", place, 1))
                if not rows:
                    continue
                for name, n in sorted(counts[e].items()):
                    if name.startswith(prefix):
                        if rest < n:
                            cuts[e, place] = (name, rest, n)
                            break
                        rest -= n
                else:
                    cuts[e, place] = (_ABOVE, 0, 0)
    return cuts


def split_links(
    links: DataFrame,
    options: SplitOptions = SplitOptions(),
    sources: DataFrame | None = None,
    targets: DataFrame | None = None,
    hard_pairs: DataFrame | None = None,
) -> DataFrame:
    """Split links of the predicted relations: ``(edge_type, src, dst, split, role, label)``.

    ``sources`` and ``targets`` (``edge_type, id``) are the nodes negatives may
    use, by default all ends seen in ``links``. Message rows are the graph all
    three splits look at. Negatives of later splits avoid earlier ones; for
    validation and test they use the ends of that split, or any node when
    those are too few. Degrees for ``degree_matched`` come from message edges.
    """
    positives = materialize(
        partition_links(links.where(F.col("edge_type").isin(*options.relations)).distinct(), options)
    )
    all_sources = sources if sources is not None else positives.select("edge_type", F.col("src").alias("id"))
    all_targets = targets if targets is not None else positives.select("edge_type", F.col("dst").alias("id"))
    degrees = None
    if options.negative_strategy == "degree_matched":
        ends = F.array(
            F.struct(F.lit("src").alias("side"), F.col("src").alias("id")),
            F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")),
        )
        degrees = (
            positives.where("role = 'message'").select("edge_type", F.explode(ends).alias("_e"))
            .groupBy("edge_type", "_e.side", "_e.id").agg(F.count(F.lit(1)).alias("degree"))
        )
    supervised = positives.where("role = 'supervision'")
    counts = supervised.groupBy("edge_type", "split").agg(F.count(F.lit(1)).alias("n")).collect()
    taken = positives.select("edge_type", "src", "dst")
    labelled = positives.withColumn("label", F.lit(1))

    for split in SPLITS:
        ratio = options.train_negatives if split == "train" else options.eval_negatives
        wanted = {r["edge_type"]: round(r["n"] * ratio) for r in counts if r["split"] == split}

        def draw(heads: DataFrame, tails: DataFrame, need: dict[str, int], split: str = split, taken: DataFrame = taken):
            return materialize(
                sample_negatives(heads, tails, taken, need, options.seed, split, options.negative_strategy,
                                 degrees, hard_pairs)
            )

        if split == "train":
            drawn = draw(all_sources, all_targets, wanted)
        else:
            own = supervised.where(F.col("split") == split)
            drawn = draw(own.select("edge_type", F.col("src").alias("id")),
                         own.select("edge_type", F.col("dst").alias("id")), wanted)
            found = {r["edge_type"]: r["n"] for r in drawn.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).collect()}
            short = {e: n for e, n in wanted.items() if found.get(e, 0) < n}
            if short:
                drawn = drawn.where(~F.col("edge_type").isin(list(short))).unionByName(
                    draw(all_sources, all_targets, short)
                )
        taken = taken.unionByName(drawn)
        labelled = labelled.unionByName(
            drawn.select("edge_type", "src", "dst", F.lit(split).alias("split"),
                         F.lit("supervision").alias("role"), F.lit(0).alias("label"))
        )
    return labelled


def split_metadata(options: SplitOptions, links: DataFrame) -> DataFrame:
    """Options and row counts of a split, one row per relation, split, role and label."""
    counts = split_counts(links)
    return counts.select(
        F.lit(options.seed).alias("seed"),
        F.lit(float(options.num_val)).alias("num_val"),
        F.lit(float(options.num_test)).alias("num_test"),
        F.lit(float(options.disjoint_train_ratio)).alias("disjoint_train_ratio"),
        F.lit(options.negative_strategy).alias("negative_strategy"),
        F.lit(float(options.train_negatives)).alias("train_negatives"),
        F.lit(float(options.eval_negatives)).alias("eval_negatives"),
        "*",
    )


def split_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("edge_type", "split", "role", "label").agg(F.count(F.lit(1)).alias("links"))


def message_links(links: DataFrame) -> DataFrame:
    """The training graph every split sees."""
    return links.where("role = 'message'").select("edge_type", "src", "dst")


def message_graph(edges: DataFrame, links: DataFrame, relations: tuple[str, ...] = PREDICTED_RELATIONS) -> DataFrame:
    """Canonical edges with predicted relations reduced to their message links; others untouched."""
    kept = message_links(links).select(
        F.col("edge_type"), F.col("src").alias("source_id"), F.col("dst").alias("target_id")
    )
    predicted = edges.where(F.col("edge_type").isin(*relations))
    return edges.where(~F.col("edge_type").isin(*relations)).unionByName(
        predicted.join(kept, ["edge_type", "source_id", "target_id"], "left_semi").select(*edges.columns)
    )


def supervision_links(links: DataFrame, split: str, label: int | None = None) -> DataFrame:
    rows = links.where((F.col("role") == "supervision") & (F.col("split") == split))
    return rows if label is None else rows.where(F.col("label") == label)


def audit_splits(links: DataFrame) -> DataFrame:
    """Violations per leakage rule and relation; every count must be 0.

    One aggregation per link key finds all overlaps, instead of a join per pair of splits.
    """
    def seen(split: str, role: str, label: int):
        hit = (F.col("split") == split) & (F.col("role") == role) & (F.col("label") == label)
        return F.max(hit.cast("int"))

    flags = links.groupBy("edge_type", "src", "dst").agg(
        seen("train", "supervision", 1).alias("tp"), seen("val", "supervision", 1).alias("vp"),
        seen("test", "supervision", 1).alias("sp"), seen("train", "message", 1).alias("m"),
        seen("train", "supervision", 0).alias("tn"), seen("val", "supervision", 0).alias("vn"),
        seen("test", "supervision", 0).alias("sn"),
    )
    rules = {
        "positives_in_two_splits": (F.col("tp") + F.col("vp") + F.col("sp")) > 1,
        "supervision_in_messages": (F.col("m") == 1) & ((F.col("tp") + F.col("vp") + F.col("sp")) > 0),
        "negatives_in_two_splits": (F.col("tn") + F.col("vn") + F.col("sn")) > 1,
        "negatives_that_are_positive": ((F.col("tn") + F.col("vn") + F.col("sn")) > 0)
        & ((F.col("tp") + F.col("vp") + F.col("sp") + F.col("m")) > 0),
    }
    counted = flags.groupBy("edge_type").agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot("edge_type", list(rules), "rule", "violations")
