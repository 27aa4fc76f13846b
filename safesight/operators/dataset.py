"""Preparation and audit of labelled image datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.functions.geometry import box, containment, cxcywh_to_xyxy, iou, xyxy_to_cxcywh
from safesight.lineage import cut, large
from safesight.schemas import CLASSES, HELMET, PERSON, VEST

#: Evaluation sets keep their size: a duplicate group goes to the first of these.
SPLIT_ORDER = ("test", "val", "train")


def _place(split: str, order: tuple[str, ...]) -> Column:
    found = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        found = F.when(F.col(split) == s, i).otherwise(found)
    return found


def remap_classes(df: DataFrame, mapping: dict[str, int], column: str = "name") -> tuple[DataFrame, DataFrame]:
    """(boxes with cls, counts of source classes without one): nothing is dropped silently. mapping is a literal of a few classes."""
    cls = F.lit(None).cast("int")
    for name, to in mapping.items():
        cls = F.when(F.col(column) == name, to).otherwise(cls)
    mapped = df.withColumn("cls", cls)
    return mapped.where("cls is not null"), mapped.where("cls is null").groupBy(column).count()


def voc_to_yolo(df: DataFrame, classes: tuple[int, ...] = (PERSON, 1, HELMET)) -> DataFrame:
    """Pixel corners to normalised centre and size; the base output has no vest."""
    c = xyxy_to_cxcywh(box(), F.col("width"), F.col("height"))
    return df.where(F.col("cls").isin(*classes)).withColumn("_c", c).select(*[x for x in df.columns if x not in ("x1", "y1", "x2", "y2")], "_c.*")


def merge_sources(**sources: DataFrame) -> DataFrame:
    """One dataset from several, with a source column."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def audit_labels(labels: DataFrame, images: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row (split, image_id, finding, n) per image and finding.

    labels: split, image_id, cls, cx, cy, w, h, error; images: split, image_id.
    """
    key = ["split", "image_id"]
    good = labels.where("error is null")
    outside = (F.col("cx") - F.col("w") / 2 < -eps) | (F.col("cx") + F.col("w") / 2 > 1 + eps) | (F.col("cy") - F.col("h") / 2 < -eps) | (F.col("cy") + F.col("h") / 2 > 1 + eps)
    tests = {"bad_line": F.col("error").isNotNull(), "class_out_of_range": ~F.col("cls").between(0, len(CLASSES) - 1), "box_outside_image": outside, "non_positive_size": (F.col("w") <= 0) | (F.col("h") <= 0)}
    names = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    found = labels.select(*key, F.explode(names).alias("finding")).groupBy(*key, "finding").agg(F.count("*").alias("n"))
    twice = good.groupBy(*key, "cls", "cx", "cy", "w", "h").agg((F.count("*") - 1).alias("n")).where("n > 0").groupBy(*key).agg(F.sum("n").alias("n")).withColumn("finding", F.lit("duplicate_box"))
    bare = images.select(*key).distinct().join(large(labels.select(*key)), key, "left_anti").withColumns({"finding": F.lit("image_without_label"), "n": F.lit(1).cast("long")})
    lost = labels.select(*key).distinct().join(large(images.select(*key)), key, "left_anti").withColumns({"finding": F.lit("label_without_image"), "n": F.lit(1).cast("long")})
    return found.unionByName(twice).unionByName(bare).unionByName(lost)


def audit_summary(findings: DataFrame) -> DataFrame:
    """Counts per split and finding with totals (null: all)."""
    return findings.rollup("split", "finding").agg(F.sum("n").alias("n"), F.count("*").alias("images"))


def audit_duplicates(files: DataFrame) -> DataFrame:
    """Groups of files with one content: sha256, group_id (smallest image_id), n, splits."""
    return files.groupBy("sha256").agg(F.min("image_id").alias("group_id"), F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("splits")).where("n > 1")


def find_split_leakage(files: DataFrame) -> DataFrame:
    """Duplicate groups that span splits."""
    return audit_duplicates(files).where(F.size("splits") > 1)


def repair_splits(files: DataFrame, order: tuple[str, ...] = SPLIT_ORDER, pairs: DataFrame | None = None) -> DataFrame:
    """files with every member of a duplicate group in one split: the group's first in order. Afterwards nothing leaks.

    Groups are equal hashes, or components of pairs (image_id, other_id) if given.
    The group's split is an aggregate that is joined back, so a large group is no single task's.
    """
    keyed = files.withColumn("_group", F.col("sha256"))
    if pairs is not None:
        keyed = files.join(large(_groups(pairs)), "image_id", "left").withColumn("_group", F.coalesce("_label", F.col("image_id").cast("string"))).drop("_label")
    best = keyed.groupBy("_group").agg(F.min_by("split", F.struct(_place("split", order), "split")).alias("_split"))
    return keyed.join(large(best), "_group").withColumn("split", F.col("_split")).select(*files.columns)


def _groups(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """image_id, _label: the smallest id reachable, by propagation with pointer jumps."""
    a, b = F.col("image_id").cast("string"), F.col("other_id").cast("string")
    edges = cut(pairs.select(a.alias("a"), b.alias("b")).unionByName(pairs.select(b.alias("a"), a.alias("b"))).distinct())
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    for _ in range(max_rounds):
        near = edges.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("n"))
        jump = label.select(F.col("a").alias("l"), F.col("l").alias("j"))
        moved = label.join(near, "a").join(jump, "l", "left").select("a", "l", F.least("l", "n", F.coalesce("j", "l")).alias("new"))
        moved = cut(moved)
        label = moved.select("a", F.col("new").alias("l"))
        if moved.where("new <> l").isEmpty():
            return label.select(F.col("a").alias("image_id"), F.col("l").alias("_label"))
    raise RuntimeError("groups did not settle")


def split_counts(df: DataFrame) -> DataFrame:
    """Images per split."""
    return df.groupBy("split").agg(F.count_distinct("image_id").alias("n"))


def check_split_counts(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Per split: count, expected count and whether they agree."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), "split string, expected long")
    return split_counts(df).join(want, "split", "full").na.fill(0, ["n", "expected"]).withColumn("ok", F.col("n") == F.col("expected"))


def diff_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed against a manifest (path, sha256)."""
    both = files.select("path", F.col("sha256").alias("now")).join(large(manifest.select("path", F.col("sha256").alias("then"))), "path", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def validate_dataset(labels: DataFrame, images: DataFrame, expected: dict[str, int], manifest: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row (check, ok, detail) per check: classes, labels, pairs, split counts, manifest."""
    findings = audit_labels(labels, images)
    count = lambda where: findings.agg(F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).alias("n"))
    pairing = F.col("finding").isin("image_without_label", "label_without_image")
    parts = [(name, count(where)) for name, where in (("classes", F.col("finding") == "class_out_of_range"), ("labels", ~pairing & (F.col("finding") != "class_out_of_range")), ("pairs", pairing))]
    parts.append(("split_counts", check_split_counts(images, expected).agg(F.sum((~F.col("ok")).cast("long")).alias("n"))))
    if manifest is not None and files is not None:
        parts.append(("manifest", diff_manifest(files, manifest).agg(F.count("*").alias("n"))))
    out = None
    for name, n in parts:
        row = n.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" findings")).alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out


#: Geometric transforms of normalised boxes; the image transform is named alike.
TRANSFORMS = ("hflip", "vflip", "rot180")


def augment_boxes(df: DataFrame, transforms: tuple[str, ...] = TRANSFORMS) -> DataFrame:
    """Originals and, for the training split only, a row per transform; transform names the image operation (null: none)."""
    train = df.where("split = 'train'").withColumn("transform", F.explode(F.array(*map(F.lit, transforms))))
    x, y = F.col("transform").isin("hflip", "rot180"), F.col("transform").isin("vflip", "rot180")
    moved = train.withColumns({"cx": F.when(x, 1 - F.col("cx")).otherwise(F.col("cx")), "cy": F.when(y, 1 - F.col("cy")).otherwise(F.col("cy")), "image_id": F.concat_ws("_", F.col("image_id").cast("string"), "transform")})
    return df.withColumn("image_id", F.col("image_id").cast("string")).withColumn("transform", F.lit(None).cast("string")).unionByName(moved)


def vest_candidates(boxes: DataFrame, k: int = 100, inside: float = 0.5) -> DataFrame:
    """Per split the k largest persons that hold no vest box (by containment), for review. boxes: split, image_id, box_id, cls, x1..y2."""
    key = ["split", "image_id"]
    persons = boxes.where(F.col("cls") == PERSON)
    vests = boxes.where(F.col("cls") == VEST).select(*key, box().alias("v"))
    worn = persons.select(*key, "box_id", box().alias("p")).join(large(vests), key).where(containment(F.col("v"), F.col("p")) >= inside).select(*key, "box_id").distinct()
    bare = persons.join(large(worn), [*key, "box_id"], "left_anti").withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    rank = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("area"), "image_id", "box_id"))
    return bare.withColumn("rank", rank).where(F.col("rank") <= k).select(*key, "box_id", "area", "rank")


def propose_dual(m1: DataFrame, m2: DataFrame, iou_min: float = 0.5) -> DataFrame:
    """Boxes that two models agree on (mutual best by IoU, ties by box_id) are 'dual', the others 'single'. m1, m2: image_id, cls, box_id, x1..y2."""
    key = ["image_id", "cls"]
    side = lambda d, n: d.select(*(F.col(c).alias(f"{c}_{n}") for c in key), F.col("box_id").alias(f"box_{n}"), F.lit(True).alias(f"in_{n}"), *(F.col(c).cast("double").alias(f"{c}_{n}") for c in ("x1", "y1", "x2", "y2")))
    b1, b2 = (box(*(f"{c}_{n}" for c in ("x1", "y1", "x2", "y2"))) for n in (1, 2))
    near = F.round(iou(b1, b2), 9)
    alike = (F.col("image_id_1") == F.col("image_id_2")) & (F.col("cls_1") == F.col("cls_2")) & (near >= iou_min)
    # boxes without any pair come from the same join as the pairs
    met = side(m1, 1).join(large(side(m2, 2)), alike, "full")
    pairs = met.select(*(F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in key), "box_1", "box_2", "in_1", "in_2", F.when(F.col("in_1") & F.col("in_2"), near).alias("iou")).repartition(*key)
    own = {n: Window.partitionBy(*key, f"in_{n}", f"box_{n}") for n in (1, 2)}
    ranked = pairs.withColumn("r1", F.row_number().over(own[1].orderBy(F.desc("iou"), "box_2"))).withColumn("r2", F.row_number().over(own[2].orderBy(F.desc("iou"), "box_1")))
    ranked = ranked.withColumn("dual", F.col("iou").isNotNull() & (F.col("r1") == 1) & (F.col("r2") == 1))
    ranked = ranked.withColumn("d1", F.max("dual").over(own[1])).withColumn("d2", F.max("dual").over(own[2]))
    # a box that is not dual is named by its first row
    alone = lambda n: F.coalesce(F.col(f"in_{n}") & (F.col(f"r{n}") == 1) & ~F.col(f"d{n}"), F.lit(False))
    kept = ranked.withColumns({"s1": alone(1), "s2": alone(2)}).where("dual or s1 or s2")
    dual = F.col("dual")
    return kept.select(*key, F.when(dual | F.col("s1"), F.col("box_1")).alias("box_1"), F.when(dual | F.col("s2"), F.col("box_2")).alias("box_2"), F.when(dual, F.col("iou")).alias("iou"), F.when(dual, "dual").otherwise("single").alias("kind"))


def apply_reviewed_boxes(labels: DataFrame, accepted: DataFrame, iou_max: float = 0.5) -> DataFrame:
    """labels with accepted vest boxes (split, image_id, cx, cy, w, h) that no vest box there overlaps; the source stays as it is."""
    key = ["split", "image_id"]
    one = F.lit(1.0)
    there = labels.where(F.col("cls") == VEST).select(*key, cxcywh_to_xyxy(F.struct("cx", "cy", "w", "h"), one, one).alias("b"))
    new = accepted.dropDuplicates([*key, "cx", "cy", "w", "h"]).withColumn("a", cxcywh_to_xyxy(F.struct("cx", "cy", "w", "h"), one, one))
    taken = new.join(large(there), key).where(iou(F.col("a"), F.col("b")) > iou_max).select(*key, "cx", "cy", "w", "h").distinct()
    fresh = new.drop("a").join(large(taken), [*key, "cx", "cy", "w", "h"], "left_anti")
    return labels.unionByName(fresh.withColumn("cls", F.lit(VEST)).select(*key, "cls", "cx", "cy", "w", "h"), allowMissingColumns=True)


def sample_preview(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of n images per split and class."""
    images = df.select("split", "cls", "image_id").distinct()
    rank = F.row_number().over(Window.partitionBy("split", "cls").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("image_id").cast("string"))), "image_id"))
    return images.withColumn("rank", rank).where(F.col("rank") <= n)
