"""Dataset curation: validation, lineage, selection, split, audit, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotable.functions import scores as S

# Forms of clip ids and upload ids, environments and distances that a manifest may state.
CLIP_ID = r"^SS-([A-Z]{3})-(\d{4})(?:S(\d+))?$"
UPLOAD_ID = r"^SST-(\d{4}-\d{2}-\d{2})-\d{6}$"
ENVIRONMENTS = ("indoor", "outdoor", "vehicle", "studio", "synthetic", "unspecified")
DISTANCES = ("near", "medium", "far", "n/a")
# Datasets whose file names hold the id of the recording: start of the source's name, and where the id stands in the file's.
RECORDING_IDS = (("UrbanSound8K", r"^(\d+)-"), ("ESC-50", r"^\d+-(\d+)-"))
# Training cuts: a clip this much longer than a cut (seconds) gives whole ones, and another one this share of its length.
CUT_SLACK_SEC = 0.3
CUT_SHORT_SHARE = 0.8
# End of fixed values.


def violations(manifest: DataFrame, classes: list[str], key: str = "audio_id") -> DataFrame:
    """``(audio_id, violation)``: one row per broken rule of a manifest row."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    copies = Window.partitionBy(key)
    rows = manifest.withColumn("_n", F.count("*").over(copies))
    found = F.array_compact(F.array(
        F.when(blank(key), "empty_id"), F.when(F.col("_n") > 1, "duplicate_id"), F.when(~F.coalesce(F.col("class_label").isin(classes), F.lit(False)), "unknown_class"),
        F.when(blank("licence"), "blank_licence"), F.when(~F.coalesce(F.col("role").isin("original", "augmented"), F.lit(False)), "bad_role"),
        F.when((F.col("role") == "augmented") & blank("parent_audio_id"), "augmented_without_parent"),
    ))
    return rows.select(key, F.explode(found).alias("violation"))


def check_rows(manifest: DataFrame, rules: dict[str, Column], key: str = "audio_id", examples: int = 5) -> DataFrame:
    """``(check, failures, examples)`` of each rule; a null rule counts as failed."""
    failed = {name: ~F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in failed.items()]))
    counts = manifest.agg(*[F.count_if(bad).alias(f"n{i}") for i, bad in enumerate(failed.values())])
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("failures")) for i, name in enumerate(failed)])).alias("x")).select("x.*")
    few = Window.partitionBy("check").orderBy(key)
    some = manifest.select(key, F.explode(broken).alias("check")).withColumn("place", F.row_number().over(few)).where(F.col("place") <= examples)
    some = some.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples"))
    return counts.join(some, "check", "left").select("check", "failures", F.coalesce("examples", F.lit("")).alias("examples"))


def lineage_faults(manifest: DataFrame) -> DataFrame:
    """``(audio_id, fault)``: missing parent, augmented parent, or another label than the parent's."""
    kids = manifest.where(F.col("parent_audio_id").isNotNull()).select("audio_id", "class_label", "parent_audio_id")
    parents = manifest.select(F.col("audio_id").alias("parent_audio_id"), F.col("role").alias("parent_role"), F.col("class_label").alias("parent_label"))
    j = kids.join(parents, "parent_audio_id", "left")
    fault = F.when(F.col("parent_role").isNull(), "missing_parent").when(F.col("parent_role") != "original", "augmented_parent").when(F.col("class_label") != F.col("parent_label"), "label_differs")
    return j.withColumn("fault", fault).where("fault is not null").select("audio_id", "fault")


def merge(manifests: list[DataFrame], key: str = "audio_id") -> DataFrame:
    """Union of manifests with different extra columns, by id."""
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out.orderBy(key)


def first_by_content(rows: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of each content; nulls in ``order`` come first, and equal ones fall to the smaller row."""
    cols = [c for c in rows.columns if c != content]
    first = F.min_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order]))
    return rows.groupBy(content).agg(first.alias("x")).select(*[F.col(content) if c == content else F.col(f"x.`{c}`") for c in rows.columns])


def round_robin(rows: DataFrame, class_col: str, uploader: str, order: str, target: int) -> DataFrame:
    """Up to ``target`` rows per class: first clips of every uploader, then second ones, ...

    Within a round, uploaders with most clips come first, then by name.
    """
    own = Window.partitionBy(class_col, uploader)
    r = rows.withColumn("_turn", F.row_number().over(own.orderBy(order))).withColumn("_many", F.count("*").over(own))
    pick = Window.partitionBy(class_col).orderBy("_turn", F.desc("_many"), uploader)
    return r.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= target).drop("_turn", "_many")


def cap_by_hash(rows: DataFrame, class_col: str, key: str, cap: int, salt: str) -> DataFrame:
    """``cap`` rows per class in salted hash order."""
    w = Window.partitionBy(class_col).orderBy(S.order_key(salt, F.col(key)), key)
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= cap).drop("_i")


def new_ids(rows: DataFrame, group: str, order: str, taken: DataFrame) -> DataFrame:
    """``rows`` with ``new_number``: the group's highest number in ``taken`` plus the row's place."""
    top = taken.groupBy(group).agg(F.max("number").alias("_top"))
    w = Window.partitionBy(group).orderBy(order)
    return rows.join(top, group, "left").withColumn("new_number", F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).drop("_top")


def by_priority(rows: DataFrame, key: str, labels: str, mapping: DataFrame) -> DataFrame:
    """First class by priority of the labels of each row; ``mapping``: label, class_name, priority."""
    each = rows.select(key, F.explode(labels).alias("label")).join(F.broadcast(mapping), "label")
    return each.groupBy(key).agg(F.min_by("class_name", F.struct("priority", "class_name")).alias("class_name"))


def first_allowed(rows: DataFrame, key: str, labels: str, mapping: DataFrame) -> DataFrame:
    """Class of the first allow-listed label in label order."""
    each = rows.select(key, F.posexplode(labels).alias("at", "label")).join(F.broadcast(mapping), "label")
    return each.groupBy(key).agg(F.min_by("class_name", "at").alias("class_name"))


def source_group(source: Column, original: Column, freesound: Column, voice: Column, phrase: Column, audio_id: Column) -> Column:
    """The recording that a clip came from, which the split keeps whole; synthetic speech goes by voice and words, any other clip alone."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    ids = [F.when(source.startswith(name), filled(F.regexp_extract(original, pattern, 1))) for name, pattern in RECORDING_IDS]
    stated = filled(F.substring_index(freesound, ".", 1))
    words = F.array_join(F.array_compact(F.transform(F.split(F.regexp_replace(F.lower(phrase), "[^a-z ]", ""), " "), filled)), " ")
    spoken = F.when(filled(phrase).isNotNull(), F.concat(F.lit("tts:"), filled(voice), F.lit(":"), words))
    return F.coalesce(F.concat(F.lit("freesound:"), F.coalesce(*ids, F.when(F.lower(stated) != "nan", stated))), spoken, F.concat(F.lit("clip:"), audio_id))


def folds(rows: DataFrame, group: str, class_col: str, k: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``: whole groups, dealt in hash order within their commonest class."""
    by = rows.groupBy(group, class_col).count()
    home = by.groupBy(group).agg(F.max_by(class_col, F.struct("count", class_col)).alias("_c"), F.sum("count").alias("_n"))
    w = Window.partitionBy("_c").orderBy(F.desc("_n"), S.order_key(str(seed), F.col(group)))
    snake = (F.row_number().over(w) - 1) % (2 * k)
    return rows.join(home.withColumn("fold", F.least(snake, F.lit(2 * k - 1) - snake).cast("int")).select(group, "fold"), group)


def coverage(manifest: DataFrame, assigned: DataFrame, key: str = "audio_id") -> DataFrame:
    """``(audio_id, state)``: ids of only one side."""
    a, b = manifest.select(F.col(key).alias("x")), assigned.select(F.col(key).alias("y"))
    j = a.join(b, F.col("x") == F.col("y"), "full").where("x is null or y is null")
    return j.select(F.coalesce("x", "y").alias(key), F.when(F.col("y").isNull(), "unassigned").otherwise("phantom").alias("state"))


def leaks(assigned: DataFrame) -> DataFrame:
    """Groups that more than one partition holds."""
    return assigned.groupBy("group").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, repeats counted, marked by side: empty where the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def duplicate_groups(rows: DataFrame, content: str, key: str) -> DataFrame:
    return rows.groupBy(content).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def imbalance(rows: DataFrame, classes: list[str], class_col: str = "class_label") -> DataFrame:
    """Counts of every class, absent ones too, with the ratio of the largest to the smallest present."""
    dim = rows.sparkSession.createDataFrame([(c,) for c in classes], f"{class_col} string")
    n = F.broadcast(dim).join(rows.groupBy(class_col).agg(F.count("*").alias("n")), class_col, "left").select(class_col, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    ratio = n.agg((F.max("n") / F.min(F.when(F.col("n") > 0, F.col("n")))).alias("ratio"))
    return n.crossJoin(F.broadcast(ratio))  # one row


def environment(stated: Column, tags: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """``(environment, basis)`` from keywords: the stated text first, then the tags, in rule order."""
    def first(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, keys in reversed(words.items()):
            hit = F.lit(False)
            for k in keys:
                hit = hit | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(k))
            out = F.when(hit, name).otherwise(out)
        return out

    a, b = first(stated), first(tags)
    return F.struct(F.coalesce(a, b, F.lit("unspecified")).alias("environment"), F.when(a.isNotNull(), "stated").when(b.isNotNull(), "inferred_from_tags").otherwise("unmatched").alias("basis"))


def attribution(manifest: DataFrame) -> DataFrame:
    """Per author: clips, licences, and the first six ids."""
    order = Window.partitionBy("author").orderBy("audio_id")
    few = manifest.withColumn("_i", F.row_number().over(order))
    return few.groupBy("author").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_i") <= 6, F.col("audio_id")))), ",").alias("first_clips"),
    )


def augmentation_plan(train: DataFrame, copies: int, recipes: list[str], noisy: tuple[str, ...] = ()) -> DataFrame:
    """``copies`` recipes for each training clip, chosen by a hash seed; noisy recipes not for noise."""
    r = train.select("audio_id", "class_label", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    r = r.withColumn("seed", S.hash_seed(F.concat_ws(":", "audio_id", F.col("copy").cast("string"))))
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("seed") % len(names) + 1).cast("int"))
    quiet = [x for x in recipes if x not in noisy]
    return r.withColumn("recipe", F.when(F.col("class_label") == "Background Noise", pick(quiet)).otherwise(pick(recipes)))


def segment_bounds(duration: Column, length: float, hop: float) -> Column:
    """Array of (start, end) on a fixed grid; one shorter segment where the clip is shorter."""
    count = F.greatest(F.lit(1), F.floor((duration - length) / hop + 1 + 1e-9).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * hop).alias("start_sec"), F.least(i * hop + length, duration).alias("end_sec")))


def select_split(manifest: DataFrame, split: str, originals_only: bool = True, split_col: str = "dataset_split") -> DataFrame:
    """Rows of one partition. A row without a partition anywhere in the manifest is an error when it is read."""
    blank = F.coalesce(F.trim(split_col), F.lit("")) == ""
    fault = F.raise_error(F.concat(F.lit("no split for "), F.coalesce("audio_id", F.lit("null")))).cast("boolean")
    rows = manifest.where(F.when(blank, fault).otherwise(F.trim(split_col) == split))
    return rows.where("role = 'original'") if originals_only else rows


def assembly_problems(manifest: DataFrame, codes: dict[str, str], environments: tuple[str, ...] = ENVIRONMENTS, distances: tuple[str, ...] = DISTANCES) -> DataFrame:
    """``(audio_id, problem)``: one row per reason for which a source's row can't be merged.

    ``codes`` maps each class to the code that its ids carry.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit("")) if c in manifest.columns else F.lit("")
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("class_label")]
    got = F.regexp_extract(text("audio_id"), CLIP_ID, 1)
    one_of = lambda c, known: (F.lower(text(c)) == "") | F.lower(text(c)).isin(*known)
    licence = F.upper(text("licence"))
    found = F.array_compact(F.array(
        F.when(text("dataset_split") != "", "split_already_set"), F.when(code.isNull(), "unknown_class"), F.when(got == "", "malformed_id"),
        F.when((got != "") & code.isNotNull() & (got != code), "code_of_another_class"), F.when(licence == "", "empty_licence"),
        F.when(licence.rlike("NON-?COMMERCIAL|-NC"), "non_commercial_licence"), F.when(~one_of("recording_environment", environments), "unknown_environment"),
        F.when(~one_of("approximate_distance", distances), "unknown_distance"), F.when(text("sha256") == "", "empty_sha256"), F.when(text("filename") == "", "empty_filename"),
    ))
    return manifest.select("audio_id", F.explode(found).alias("problem"))


def clip_id_parts(audio_id: Column) -> Column:
    """``(code, number, segment)`` of a clip id such as SS-GUN-0042 or SS-GUN-0042S1; nulls for another form."""
    part = lambda i: F.when(F.regexp_extract(audio_id, CLIP_ID, i) != "", F.regexp_extract(audio_id, CLIP_ID, i))
    return F.struct(part(1).alias("code"), part(2).cast("int").alias("number"), part(3).cast("int").alias("segment"))


def day_of_recording(audio_id: Column) -> Column:
    """The day in an upload's id (SST-YYYY-MM-DD-NNNNNN); null for another form."""
    day = F.regexp_extract(audio_id, UPLOAD_ID, 1)
    return F.when(day != "", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))


def defects(rows: DataFrame, shortest: float = 0.5, quietest_dbfs: float = -50.0, key: str = "audio_id") -> DataFrame:
    """``(key, defect)`` of measured clips that are too short or too quiet to keep."""
    found = F.array_compact(F.array(F.when(F.col("duration_sec") < shortest, "too_short"), F.when(F.col("rms_dbfs") <= quietest_dbfs, "too_quiet")))
    return rows.select(key, F.explode(found).alias("defect"))


def unmatched_files(manifest: DataFrame, listing: DataFrame, name: str = "filename") -> DataFrame:
    """``(filename, state)``: manifest rows whose file isn't listed, and listed files without a row."""
    rows, files = manifest.select(name).distinct(), listing.select(name).distinct()
    missing = rows.join(files, name, "left_anti").withColumn("state", F.lit("file_missing"))
    return missing.unionByName(files.join(rows, name, "left_anti").withColumn("state", F.lit("not_in_manifest")))


def keep_lowest(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of lowest ``order`` of each group; Spark cuts each task's groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def reason_counts(rows: DataFrame, reason: Column) -> DataFrame:
    """``(reason, n)``: how often each reason to skip or take a clip was given; null is 'accepted'."""
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def covering_bounds(n_samples: Column, length: Column) -> Column:
    """Array of (start, end) samples: evenly spread segments of ``length`` that cover every sample.

    A clip of up to one length is one segment; one without samples has none.
    """
    count = F.ceil(n_samples / length).cast("int")
    step = (n_samples - length) / F.greatest(count - 1, F.lit(1))
    even = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.bround(i * step).cast("long"))
    spread = F.transform(F.array_distinct(even), lambda s: F.struct(s.alias("start"), F.least(n_samples, s + length).cast("long").alias("end")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n_samples.cast("long").alias("end")))
    return F.when(n_samples <= 0, F.slice(whole, 1, 0)).when(n_samples <= length, whole).otherwise(spread)


def fraction_cuts(clips: DataFrame, fractions: tuple[float, ...], length: float, shortest: float, slack: float = CUT_SLACK_SEC, share: float = CUT_SHORT_SHARE) -> DataFrame:
    """Training cuts of clips, numbered in the order of ``fractions``, with their parent's lineage and other columns.

    A cut begins at its fraction of the clip, or where the last whole one would; two of one start are one. It is ``length``
    long, or ``share`` of a clip that has not ``slack`` seconds more than that, but ``shortest`` at least.
    """
    whole = F.col("duration_sec")
    size = F.when(whole - length < slack - 1e-12, F.greatest(whole * share, F.lit(shortest))).otherwise(F.lit(length))
    cut = clips.withColumn("_size", size).withColumn("_last", F.greatest(whole - F.col("_size"), F.lit(0.0)))
    begin = F.transform(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: F.round(F.when(f * whole < F.col("_last"), f * whole).otherwise(F.col("_last")), 3))
    cut = cut.select("*", F.posexplode(F.array_distinct(begin)).alias("_nth", "_begin"))
    own = {
        "audio_id": F.format_string("%sS%d", F.col("audio_id"), F.col("_nth") + 1), "parent_audio_id": F.col("audio_id"), "role": F.lit("augmented"), "duration_sec": F.round("_size", 3),
        "segment_start_sec": F.col("_begin"), "segment_end_sec": F.round(F.col("_begin") + F.col("_size"), 3),
    }
    return cut.select(*[c.alias(name) for name, c in own.items()], *[c for c in clips.columns if c not in own])
