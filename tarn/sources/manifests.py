"""Manifests of mixed sources: records from rows of any shape, media lookups, prediction folders, resumable ingest.

Rows of unknown shape are VARIANT (`variants`), so every key lookup is a JVM expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import text as T
from ..functions.scores import missing, stable_id

#: Keys by which sources name things, in order of preference (fixed values).
QUESTION = ["question", "query", "prompt", "instruction", "q"]
ANSWER = ["answer", "response", "output", "caption", "text", "a"]
CAPTION = ["caption", "dense_caption", "description", "cap"]
CHOICES = ["choices", "options", "candidates"]
MEDIA = ["video", "video_path", "video_name", "video_id", "videoid", "image", "image_path"]
IDENTIFIER = ["id", "uid", "qid", "question_id", "video_id", "videoid"]
WRAPPERS = ["data", "annotations", "records"]
VIDEO_SUFFIXES = [".mp4", ".avi", ".mov", ".mkv", ".webm", ".gif", ".m4v"]


def variants(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT row `v` a record: lines of JSON, or a document that is an array, an object with one under a wrapper key, or one object."""
    if path.lower().endswith((".jsonl", ".jsonl.gz")):
        return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json(F.when(F.trim("value") != "", F.col("value"))).alias("v"))
    return unwrapped(spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.parse_json("value").alias("v")))


def unwrapped(documents: DataFrame, column: str = "v") -> DataFrame:
    lists = [F.try_variant_get(column, f"$.{k}", "array<variant>") for k in WRAPPERS]
    whole = F.try_variant_get(column, "$", "array<variant>")
    return documents.select(F.explode(F.coalesce(whole, *lists, F.array(F.col(column)))).alias("v"))


def value(v: Column, keys: Sequence[str], any_case: bool = False) -> Column:
    """The first of the keys with a value that is neither null nor empty, as text (objects and lists as JSON)."""
    filled = lambda t: F.when(t != "", t)
    found = [filled(F.try_variant_get(v, f"$['{k}']", "string")) for k in keys]
    if any_case:
        entries = F.transform_keys(F.try_variant_get(v, "$", "map<string,string>"), lambda k, _: k)
        lower = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys(entries), F.lower)), lambda k: F.struct(k.alias("k"), F.get(F.map_values(F.map_filter(entries, lambda n, x: (F.lower(n) == k) & (x != ""))), F.lit(0)).alias("v"))))
        found += [filled(F.try_element_at(lower, F.lit(k.lower()))) for k in keys]
    return F.coalesce(*found)


def has(v: Column, keys: Sequence[str]) -> Column:
    return value(v, keys).isNotNull()


def exchange(v: Column) -> Column:
    """struct(question, answer): the first user's and the first assistant's text of a message list, media marks cut out of the question."""
    lists = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("conversations", "conversation", "messages")))
    first = lambda *roles: F.get(F.filter(F.transform(F.filter(lists, lambda m: F.lower(value(m, ["from", "role", "speaker"])).isin(*roles)), lambda m: value(m, ["value", "content", "text"])), lambda t: t.isNotNull()), F.lit(0))
    bare = F.trim(F.replace(F.replace(first("human", "user"), F.lit("<video>"), F.lit("")), F.lit("<image>"), F.lit("")))
    return F.struct(bare.alias("question"), F.trim(first("gpt", "assistant")).alias("answer"))


def media_path(raw: Column, root: str = "", suffix: str = ".mp4") -> Column:
    """A URL as it is; else a path with a suffix, below the root unless absolute; '' for nothing."""
    named = F.when(raw.rlike(r"(^|/)[^/]*\.[^./]+$") | F.lit(suffix == ""), raw).otherwise(F.concat(raw, F.lit(suffix)))
    below = F.when(named.startswith("/") | F.lit(root == ""), named).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), named))
    return F.when(raw.isNull(), "").when(raw.rlike("^https?://"), raw).otherwise(below)


def normalized(rows: DataFrame, source: str, root: str = "", suffix: str = ".mp4") -> DataFrame:
    """Records of rows `v` of any shape: id, source, benchmark, task, media_type, media_path, question, answer, choices. Rows without an answer go."""
    v = F.col("v")
    talk = exchange(v)
    filled = lambda t: F.when(t != "", t)
    listed = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.from_json(F.try_variant_get(v, f"$.{k}", "string"), "array<string>"))
    choices = F.coalesce(*(F.when(F.size(listed(k)) > 0, listed(k)) for k in CHOICES))
    out = rows.select(
        "v", F.coalesce(filled(talk["question"]), value(v, QUESTION)).alias("q"), F.coalesce(filled(talk["answer"]), value(v, ANSWER)).alias("a"), value(v, CAPTION).alias("cap"), choices.alias("choices"),
        F.coalesce(value(F.coalesce(F.try_variant_get(v, "$.video", "variant"), v), ["path", "filename"]), value(v, MEDIA)).alias("raw"), has(v, ["image", "image_path"]).alias("image"), value(v, IDENTIFIER).alias("own"),
    )
    out = out.withColumn("a", F.when(F.col("q").isNull() & F.col("cap").isNotNull(), F.col("cap")).otherwise(F.col("a"))).withColumn("q", F.when(F.col("q").isNull() & F.col("cap").isNotNull(), "Describe the video.").otherwise(F.col("q"))).where("a IS NOT NULL")
    task = F.when(F.size("choices") > 0, "mcq").when(F.lower(F.coalesce("q", F.lit("None"))).startswith("describe"), "caption").otherwise("qa")
    ident = F.coalesce(F.col("own"), stable_id(F.lit(source), F.col("q"), F.col("a")))
    return out.select(
        F.concat(F.lit(f"{source}_"), ident).alias("id"), F.lit(source).alias("source"), F.lit(source).alias("benchmark"), task.alias("task"), F.when(F.col("image"), "image").otherwise("video").alias("media_type"),
        media_path(F.col("raw"), root, suffix).alias("media_path"), F.trim("q").alias("question"), F.trim("a").alias("answer"), "choices",
    )


def dataset_spec(text: str) -> dict[str, str | None]:
    """owner/name[:config][:split] as dataset_id, config, split and a source alias."""
    parts = text.split(":")
    if len(parts) > 3:
        raise ValueError(f"not owner/name[:config][:split]: {text}")
    config, split = (parts[1], parts[2]) if len(parts) == 3 else (None, parts[1] if len(parts) == 2 else "train")
    name = parts[0].split("/")[-1].lower()
    return {"dataset_id": parts[0], "config": config, "split": split, "source": f"{name}_{config}" if config else name}


def capped(rows: DataFrame, spec: dict[str, str | None], most: int | None = None) -> DataFrame:
    """Landed rows of a source with its alias and split, `most` of them at most."""
    out = rows.withColumns({"_source_alias": F.lit(spec["source"]), "_split": F.lit(spec["split"])})
    return out if most is None else out.limit(most)


def dataset_uri(uri: Column) -> Column:
    """struct(repo_id, revision, filename) of hf://datasets/<owner>/<name>[@revision]/<file>; null for other texts."""
    p = r"^hf://datasets/([^/]+)/([^/@]+)(?:@([^/]*))?/(.+)$"
    g = lambda i: F.regexp_extract(uri, p, i)
    return F.when(uri.rlike(p), F.struct(F.concat(g(1), F.lit("/"), g(2)).alias("repo_id"), F.when(g(3) != "", g(3)).alias("revision"), F.url_decode(F.replace(g(4), F.lit("+"), F.lit("%2B"))).alias("filename")))


def hash_order(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A shuffled order that depends on the seed and the keys alone: ties by the keys."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def sampled(rows: DataFrame, n: int | None, seed: int, *keys: str) -> DataFrame:
    """n rows by a seeded hash of their keys; all where n is missing or not positive."""
    return rows if n is None or n <= 0 else hash_order(rows, seed, *keys).limit(n)


# multiple-choice items in trees of JSON -----------------------------------------------------------------------------


def mcq_items(documents: DataFrame, depth: int = 6) -> DataFrame:
    """file, path, v: objects with a question, choices and an answer, anywhere in documents (file, v); what is inside one is not searched.

    The tree is unfolded level by level with variant_explode, `depth` levels at most; a deeper document raises.
    """
    is_item = lambda v: has(v, QUESTION[:3]) & F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant") for k in CHOICES)).isNotNull() & has(v, ["answer", "label", "solution"])
    level, found = documents.select("file", F.lit("").alias("path"), "v"), None
    for _ in range(depth):
        items = level.where(is_item(F.col("v")))
        found = items if found is None else found.unionByName(items)
        rest = level.where(~F.coalesce(is_item(F.col("v")), F.lit(False)))
        level = rest.lateralJoin(spark_tvf(rest)).select("file", F.concat_ws("/", "path", F.format_string("%06d", F.col("pos"))).alias("path"), F.col("value").alias("v"))
        level = level.where(F.schema_of_variant("v").startswith("OBJECT") | F.schema_of_variant("v").startswith("ARRAY"))
    deeper = level.select("file", F.raise_error(F.lit("documents are nested too deeply")).cast("string").alias("path"), "v")
    return found.unionByName(deeper)


def spark_tvf(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer())


def choice_text(c: Column) -> Column:
    """The text of a choice: of an object the first of its text keys, else its JSON."""
    keys = ["text", "value", "answer", "caption", "label", "name"]
    is_object = F.schema_of_variant(c).startswith("OBJECT")
    return F.trim(F.when(is_object, F.coalesce(value(c, keys), F.to_json(c))).otherwise(F.variant_get(c, "$", "string")))


def choice_list(raw: Column) -> Column:
    """Choices of a list, or of an object in the order of its keys; empty ones of a list go."""
    keyed = F.try_variant_get(raw, "$", "map<string,variant>")
    by_key = F.transform(F.array_sort(F.map_keys(keyed)), lambda k: choice_text(F.element_at(keyed, k)))
    listed = F.filter(F.transform(F.try_variant_get(raw, "$", "array<variant>"), choice_text), lambda t: t != "")
    return F.coalesce(listed, by_key, F.array().cast("array<string>"))


def choice_answer(answer: Column, choices: Column) -> Column:
    """A letter as upper case, a choice's text (whatever the case) as its letter, anything else as it is; '' for nothing."""
    said = F.trim(F.coalesce(answer, F.lit("")))
    place = F.array_position(F.transform(choices, F.lower), F.lower(said))
    return F.when(F.coalesce(F.size(choices), F.lit(0)) == 0, said).when(said.rlike("^[A-Za-z]$"), F.upper(said)).when(place > 0, F.char(place + 64)).otherwise(said)


def any_answer(raw: Column, choices: Column) -> Column:
    """A whole number as a 0-based place, else as a 1-based one; other answers by letter or text. raw: VARIANT."""
    kind = F.schema_of_variant(raw)
    i = F.try_variant_get(raw, "$", "int")
    n = F.size(choices)
    said = F.coalesce(value(raw, ["answer", "text", "value", "label"]), F.when(~kind.startswith("OBJECT"), F.try_variant_get(raw, "$", "string")))
    number = F.when((i >= 0) & (i < n), F.char(i + 65)).when((i >= 1) & (i <= n), F.char(i + 64))
    return F.when(kind.isin("BIGINT", "INT"), F.coalesce(number, choice_answer(said, choices))).otherwise(choice_answer(said, choices))


def semantic_key(media: Column, question: Column, choices: Column, answer: Column) -> Column:
    """What makes two items the same question."""
    flat = lambda t: F.lower(X.collapsed(t))
    return F.struct(media.alias("media"), flat(question).alias("question"), F.transform(choices, flat).alias("choices"), F.upper(F.trim(answer)).alias("answer"))


def deduplicated(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by `order`: an aggregation, so a key with very many rows is reduced before the shuffle."""
    names = rows.columns
    return rows.withColumn("__k", key).groupBy("__k").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r")).select("r.*")


def unique_ids(rows: DataFrame, ident: str, order: list[str], suffix: Column) -> DataFrame:
    """Later rows of one id get a suffix."""
    place = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    return rows.withColumn("__n", place).withColumn(ident, F.when(F.col("__n") > 1, F.concat_ws("_", ident, suffix)).otherwise(F.col(ident))).drop("__n")


def media_index(files: DataFrame, root: str) -> DataFrame:
    """key, path: every name under which a file (path) may be asked for: path, tails of it below the root, each with and without suffix."""
    below = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    parts = F.split(below, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    bare = F.transform(tails, lambda t: F.regexp_replace(t, r"\.[^./]+$", ""))
    return files.select("path", F.explode(F.array_distinct(F.concat(F.array(F.col("path")), tails, bare))).alias("key")).where("key <> ''")


def looked_up(rows: DataFrame, raw: str, index: DataFrame, into: str = "media_path") -> DataFrame:
    """rows with the file of their media name: the first candidate spelling that the index knows, of several files the first."""
    said = F.trim(F.col(raw))
    bare = F.regexp_replace(F.regexp_replace(said, r"\\", "/"), "^[./]+", "")
    name = F.element_at(F.split(bare, "/"), -1)
    more = [F.concat(n, F.lit(s)) for n in (bare, name) for s in VIDEO_SUFFIXES]
    asked = F.array_distinct(F.array(said, bare, *(F.concat(F.lit(f"{p}/"), bare) for p in ("video", "videos", "mvbench_video")), name, F.regexp_replace(name, r"\.[^./]+$", ""), *more))
    keyed = rows.withColumn("__row", F.monotonically_increasing_id())
    # rows keep their own id through a hash of their content: ids of a re-run task must not matter
    keyed = keyed.withColumn("__row", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    wanted = keyed.select("__row", F.posexplode(asked).alias("rank", "key")).distinct()
    first = index.groupBy("key").agg(F.min("path").alias("path"))
    best = wanted.join(first, "key").groupBy("__row").agg(F.min_by("path", "rank").alias(into))
    return keyed.join(best, "__row", "left").drop("__row")


def valid_media(rows: DataFrame, files: DataFrame, least: int = 131_072, allow_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows whose file is there and large enough, counts by reason). files: (path, length) of a binaryFile listing."""
    known = rows.join(files.select(F.col("path").alias("__p"), F.col("length").alias("__l")), F.col("media_path") == F.col("__p"), "left")
    reason = F.when(F.col("__l").isNull(), "missing").when((F.lit(least) > 0) & (F.col("__l") < least), "too_small").otherwise("kept")
    marked = known.withColumn("reason", reason)
    keep = F.col("reason").isin("kept", "missing") if allow_missing else F.col("reason") == "kept"
    return marked.where(keep).drop("__p", "__l", "reason"), marked.groupBy("reason").agg(F.count("*").alias("rows"))


def fewer_than(rows: DataFrame, least: int) -> bool:
    """Whether there are under `least` rows; stops counting there."""
    return rows.limit(least).count() < least


# groups of four ------------------------------------------------------------------------------------------------------


def two_choice_question(said: Column) -> Column:
    """struct(question, choices) of lines: lettered ones are choices, the instruction line goes; null unless there are two."""
    lines = F.filter(F.transform(F.split(said, r"\r\n|[\n\r]"), lambda t: F.trim(t)), lambda x: x != "")
    pattern = r"^\(?([A-Za-z])[.):]\s*(.+)$"
    choices = F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.trim(F.regexp_extract(x, pattern, 2)))
    rest = F.filter(lines, lambda x: ~x.rlike(pattern) & ~F.lower(x).startswith("answer with the option"))
    return F.when(F.size(choices) == 2, F.struct(F.array_join(rest, "\n").alias("question"), choices.alias("choices")))


def categories(rows: DataFrame) -> DataFrame:
    """group_id, major_category, minor_categories, categories of rows (index, major, minor): minor ones are split at semicolons."""
    major = F.coalesce(F.when(~missing(F.col("major")), F.trim("major")), F.lit("unknown"))
    minor = F.filter(F.transform(F.split(F.coalesce("minor", F.lit("")), ";"), lambda t: F.trim(t)), lambda x: x != "")
    return rows.select(F.col("index").cast("int").alias("group_id"), major.alias("major_category"), minor.alias("minor_categories"), F.concat(F.array(major), minor).alias("categories"))


def group_records(items: DataFrame, score_type: str, category: DataFrame, root: str) -> DataFrame:
    """Records of items (idx '<group>_<role>', question, video_name, GT) with the categories of their group."""
    p = r"^(.*)_([^_]*)$"
    out = items.withColumns({"group_id": F.regexp_extract("idx", p, 1).try_cast("int"), "pair_role": F.regexp_extract("idx", p, 2), "m": two_choice_question(F.col("question"))}).join(category, "group_id", "left")
    return out.select(
        F.concat_ws(":", F.lit("vinoground"), F.lit(score_type), "idx").alias("id"), F.lit("Vinoground").alias("source"), F.lit(f"Vinoground-{score_type}").alias("benchmark"), F.col("major_category").alias("task_type"), "group_id", F.col("idx").alias("official_idx"),
        F.lit(score_type).alias("score_type"), "pair_role", "major_category", "minor_categories", "categories", F.lit("video").alias("media_type"), F.concat(F.lit(root.rstrip("/") + "/"), "video_name").alias("media_path"),
        F.col("m.question").alias("question"), F.col("m.choices").alias("choices"), F.upper(F.trim("GT")).alias("answer"),
    )


def incomplete_groups(records: DataFrame, size: int = 2) -> DataFrame:
    return records.groupBy("group_id", "score_type").agg(F.count("*").alias("n")).where(F.col("n") != size)


# exported video rows -------------------------------------------------------------------------------------------------


def caption_variants(rows: DataFrame, captions: str, count: int = 1, place: int = 0) -> DataFrame:
    """A row for each of the first `count` captions of a list (one at `place` for count 1); rows without captions stay, with null."""
    c = F.col(captions)
    one = X.value_text(c, place)
    if count <= 1:
        return rows.withColumns({"caption_index": F.lit(None).cast("int"), "caption": one})
    listed = F.when(F.size(c) > 0, F.slice(c, 1, count))
    return rows.select("*", F.posexplode_outer(listed).alias("caption_index", "caption"))


def row_identifier(rows: DataFrame, *candidates: str, place: str = "row_index") -> Column:
    """The first identifier that is there; of paths the file name without suffix; else row_<place>."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^./]+$", "")
    found = [F.when(~missing(F.col(c)), stem(F.col(c).cast("string")) if "path" in c else F.col(c).cast("string")) for c in candidates if c in rows.columns]
    return F.coalesce(*found, F.format_string("row_%06d", F.col(place)))


def exported_records(rows: DataFrame, dataset_id: str) -> DataFrame:
    """Records of rows (row_id, row_index, media_path, question, answer, choices, caption, caption_index, label)."""
    answer = F.coalesce(F.when(~missing(F.col("answer")), F.col("answer")), F.when(~missing(F.col("caption")), F.col("caption")))
    task = F.when((F.size("choices") > 0) & answer.isNotNull(), "mcq").when(answer.isNotNull(), "caption").otherwise("diagnostic")
    tag = F.when(F.col("caption_index").isNotNull(), F.format_string("_cap%02d", F.col("caption_index"))).otherwise("")
    name = T.safe_id(F.lit(dataset_id))
    return rows.select(
        F.concat(name, F.lit("_"), T.safe_id(F.col("row_id")), tag).alias("id"), F.lit(dataset_id).alias("source"), F.concat(name, F.lit("_diagnostic")).alias("benchmark"), task.alias("task"), F.lit("video").alias("media_type"), "media_path",
        F.coalesce(F.when(~missing(F.col("question")), F.col("question")), F.lit("Describe the video.")).alias("question"), F.coalesce(answer, F.lit("")).alias("answer"), "choices", "caption", "label", F.col("row_id").alias("video_id"), "row_index", "caption_index",
    )


def label_names(rows: DataFrame, column: str, names: DataFrame, into: str = "label") -> DataFrame:
    """Class numbers as names (number, name); others as text, blanks as null."""
    found = rows.join(F.broadcast(names.select(F.col("number").cast("string").alias("__n"), F.col("name").alias("__name"))), F.col(column).cast("string") == F.col("__n"), "left")
    return found.withColumn(into, F.coalesce("__name", F.when(~missing(F.col(column)), F.col(column).cast("string")))).drop("__n", "__name")


def not_seen(rows: DataFrame, manifest: DataFrame, prefix: str = "activitynet_") -> DataFrame:
    """Rows whose video_id no manifest record names (by video_id, else by the id behind a prefix): what is left to fetch."""
    own = F.coalesce(F.when(~missing(F.col("video_id")), F.col("video_id").cast("string")), F.when(F.col("id").startswith(prefix), F.substring("id", F.lit(len(prefix) + 1), F.length("id"))))
    seen = manifest.select(own.alias("__seen")).where("__seen IS NOT NULL").distinct()
    return rows.where(~missing(F.col("video_id"))).join(seen, F.col("video_id").cast("string") == F.col("__seen"), "left_anti")


def to_fetch(rows: DataFrame, manifest: DataFrame, longest: float = 0, most: int | None = None, seed: int = 42) -> DataFrame:
    """Rows (video_id, video_url, duration) still to fetch: not seen, with a URL, not too long; `most` of them by seeded hash."""
    fit = F.col("duration").isNull() | F.lit(longest <= 0) | (F.col("duration") <= longest)
    left = not_seen(rows, manifest).where(~missing(F.col("video_url")) & fit).dropDuplicates(["video_id"])
    return sampled(left, most, seed, "video_id")


def clip_record(rows: DataFrame, source: str = "activitynet") -> DataFrame:
    """Diagnostic records of fetched rows (video_id, path, duration, label, youtube_url)."""
    return rows.select(
        F.concat(F.lit(f"{source}_"), "video_id").alias("id"), F.lit(source).alias("source"), F.lit(f"{source}_diagnostic").alias("benchmark"), F.lit("diagnostic").alias("task"), F.lit("video").alias("media_type"), F.col("path").alias("media_path"),
        F.lit("Describe the video.").alias("question"), F.lit("").alias("answer"), F.lit(None).cast("array<string>").alias("choices"), "duration", "label", "video_id", "youtube_url",
    )


# folders of results --------------------------------------------------------------------------------------------------


def by_folder(spark: SparkSession, root: str, file: str, names: Sequence[str], schema: str | None = None) -> DataFrame:
    """All files <root>/<name1>/.../<file> with their folder names as columns; no file gives no rows where a schema is given."""
    pattern = "/".join([root.rstrip("/"), *["*"] * len(names), file])
    path = F.split(F.col("_metadata.file_path"), "/")
    add = [F.url_decode(F.element_at(path, -(len(names) + 1 - i))).alias(n) for i, n in enumerate(names)]
    try:
        rows = spark.read.csv(pattern, header=True) if file.endswith(".csv") else (spark.read.schema(schema) if schema else spark.read).json(pattern)
    except Exception as e:  # an absent partition is an empty relation, anything else is not
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, " + ", ".join(f"{n} string" for n in names))
    return rows.select(*rows.columns, *add)


def last_by_id(rows: DataFrame, ident: str, order: Column) -> DataFrame:
    """The last row of each id as text: what a lookup filled in file order would hold."""
    names = [c for c in rows.columns if c != ident]
    return rows.withColumn("__o", order).groupBy(F.col(ident).cast("string").alias(ident)).agg(F.max_by(F.struct(*names), "__o").alias("r")).select(ident, "r.*")


def folders(spark: SparkSession, root: str, given: str | None = None) -> list[str]:
    """Names given as a comma-joined text, else of the folders below a root; none if it is not there."""
    if given:
        return [x.strip() for x in given.split(",") if x.strip()]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def absent_parts(spark: SparkSession, root: str, names: Sequence[str], modes: Sequence[str], file: str = "predictions.jsonl") -> list[str]:
    """Paths <root>/<name>/<mode>/<file> that are missing or empty."""
    jvm, out = spark.sparkContext._jvm, []
    for name in names:
        for mode in modes:
            path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/{mode}/{file}")
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if not fs.exists(path) or fs.getContentSummary(path).getLength() == 0:
                out.append(str(path.toString()))
    return out


def row_task(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """rows (id) with `task_name`: their own task_type or benchmark, else the manifest's, else unknown."""
    known = manifest.select(F.col("id").cast("string").alias("__id"), *(F.col(c).alias(f"__{c}") for c in ("task_type", "benchmark")))
    both = rows.join(known, F.col("id").cast("string") == F.col("__id"), "left")
    own = [F.col(c) for c in ("task_type", "benchmark") if c in rows.columns]
    return both.withColumn("task_name", F.coalesce(X.present(*own, F.col("__task_type"), F.col("__benchmark")), F.lit("unknown"))).drop("__id", "__task_type", "__benchmark")


def report_rows(table: DataFrame, group: str, metrics: list[str], order: list[str]) -> DataFrame:
    """Rows of a group, metrics as numbers (null where they are none), in a given order of names, then by name."""
    rows = table.where(F.col("group").cast("string") == group) if "group" in table.columns else table
    place = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("encoder"))
    numbers = {m: F.col(m).cast("string").try_cast("double") for m in metrics if m in table.columns}
    return rows.withColumns(numbers).orderBy(F.when(place > 0, place).otherwise(len(order) + 1), "encoder")
