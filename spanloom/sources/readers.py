"""Readers of annotated corpora, span tables, linkage inputs and reports. All are lazy and use Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

TAG = "struct<start:int,end:int,tag:string>"
CORPUS = f"id string, text string, tags array<{TAG}>, lang string"


def jsonl(spark: SparkSession, path: str, strict: bool = True, schema: str = CORPUS) -> DataFrame:
    """One object a line. strict: a bad line fails the read; else bad lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of whole files; the id is the name up to its first full stop."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.element_at(F.split("_metadata.file_name", r"\."), 1).alias("id"))
    return rows.select("id", "text")


def brat(spark: SparkSession, path: str) -> DataFrame:
    """`T1<TAB>TAG start end<TAB>text` lines of .ann files; others are left out."""
    rows = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", r"\.ann$", "").alias("filename"), F.split("value", "\t").alias("p"), "value")
    mid = F.split(F.try_element_at("p", F.lit(2)), " ")
    rows = rows.where(~F.startswith("value", F.lit("#"))).select(
        "filename", F.try_element_at("p", F.lit(1)).alias("ann_id"), F.try_element_at(mid, F.lit(1)).alias("label"), F.try_element_at(mid, F.lit(2)).try_cast("int").alias("start"),
        F.try_element_at(mid, F.lit(3)).try_cast("int").alias("end"), F.try_element_at("p", F.lit(3)).alias("text"),
    )
    return rows.where("ann_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")


def span_tsv(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """filename, label, start_span, end_span, text as strings without quoting; labels filtered without regard to case, upper-cased; repeated spans left out."""
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").option("nullValue", "\u0000").csv(path)
    rows = rows.withColumnsRenamed({"name": "filename", "tag": "label"})
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns]).withColumn("label", F.upper("label")).where("label <> ''")
    if labels is not None:
        rows = rows.where(F.col("label").isin([x.upper() for x in labels]))
    rows = rows.withColumn("offset", F.concat_ws(" ", "start_span", "end_span"))
    return rows.dropDuplicates(["filename", "label", "offset"])


def mixed_tsv(spark: SparkSession, paths: list[str], required: tuple[str, ...] = ("filename", "label"), optional: tuple[str, ...] = ("start_span", "end_span", "text")) -> DataFrame:
    """Tables whose optional columns differ, one below the other; an empty required value fails the read."""
    out = None
    for path in paths:
        rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
        if missing := set(required) - set(rows.columns):
            raise ValueError(f"{path} lacks {sorted(missing)}")
        named = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("") for c in (*required, *optional)}
        named |= {c: F.when(named[c] == "", F.raise_error(F.lit(f"{path}: empty {c}"))).otherwise(named[c]) for c in required}
        rows = rows.select(*[v.alias(c) for c, v in named.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def numbered_lines(spark: SparkSession, path: str, count_blank: bool = True) -> DataFrame:
    """(line_num, text) of one file from 0, blank lines left out; count_blank: whether they take a number.

    Lines are numbered within their split of the file, and splits by the number of lines before them: two scans, nothing in one task but a row a split.
    """
    rows, filled = spark.read.text(path).select(F.col("value").alias("text")), F.rlike("text", F.lit(r"\S"))
    rows = (rows if count_blank else rows.where(filled)).withColumn("at", F.monotonically_increasing_id()).withColumn("split", F.shiftright("at", 33))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.where(filled).join(splits, "split").select((F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("line_num"), "text")


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {entity_group, word, start, end} as spans of one document."""
    rows = spark.read.option("multiLine", True).schema("entity_group string, word string, start int, end int").json(path)
    return rows.select(F.lit("document").alias("filename"), F.upper("entity_group").alias("label"), F.col("start").alias("start_span"), F.col("end").alias("end_span"), F.col("word").alias("text"))


def folds(spark: SparkSession, path: str) -> DataFrame:
    """(fold, role, gid) of a fold file with folds [{train_files, val_files}] and test_files or test_gids; `.txt` is cut off."""
    raw = spark.read.option("multiLine", True).json(path)
    parts = [
        raw.select(F.posexplode("folds").alias("fold", "f")).select("fold", F.lit(role).alias("role"), F.explode(f"f.{name}").alias("gid")) for role, name in (("train", "train_files"), ("val", "val_files"))
    ]
    for name in ("test_files", "test_gids"):
        if name in raw.columns:
            parts.append(raw.select(F.lit(-1).alias("fold"), F.lit("test").alias("role"), F.explode(name).alias("gid")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("gid", F.regexp_replace("gid", r"\.txt$", ""))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """`id||name[||name...]` lines as (id, name): lower-cased, without `cui-less`; `composite` marks ids joined by + or |."""
    rows = spark.read.text(path).select(F.split("value", r"\|\|").alias("p")).where(F.size("p") >= 2)
    rows = rows.select(F.element_at("p", 1).alias("id"), F.explode(F.slice("p", 2, 1000)).alias("name"))
    return rows.select("id", F.lower(F.trim("name")).alias("name"), F.col("id").rlike(r"[+|]").alias("composite")).where("lower(id) <> 'cui-less' AND name <> ''")


def with_source(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """CSV files with a header, one below the other, with the name of the file that a row is from."""
    return spark.read.option("header", True).csv(paths).withColumn("_source_file", F.col("_metadata.file_name"))


def reports(spark: SparkSession, path: str, name: str = "eval_results.json") -> DataFrame:
    """JSON reports below a folder as (file, metric, value); a metric within an object is named `outer_inner`. What is no number is left out."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    kind = "map<string,string>"
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json("value", kind)).alias("metric", "value"))
    inner = F.transform_keys(F.from_json("value", kind), lambda k, _: F.concat_ws("_", "metric", k))
    rows = rows.select("file", F.explode(F.when(F.startswith("value", F.lit("{")), inner).otherwise(F.create_map("metric", "value"))).alias("metric", "value"))
    return rows.withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL")


def latin1_lines(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 text as one column, whatever is in a line."""
    return spark.read.option("sep", "\u0001").option("encoding", "ISO-8859-1").option("quote", "").schema("text string").csv(path)


def checked_parquet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The required columns of a Parquet table; a missing one is an error."""
    rows = spark.read.parquet(path)
    if missing := set(required) - set(rows.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return rows.select(*required)


def first_split(tables: dict[str, DataFrame], id_col: str, text_col: str) -> DataFrame:
    """Of named splits the first of train, validation, test, all, or else any; rows without an id or a text are left out."""
    name = next((n for n in ("train", "validation", "test", "all") if n in tables), next(iter(tables)))
    return tables[name].where((F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(text_col), F.lit("")) != ""))


def lookup_by_line(rows: DataFrame, lines: DataFrame, line_col: str) -> DataFrame:
    """Rows with the text of their line number; a null or negative number and one beyond the end have no text."""
    valid = F.when(F.col(line_col) >= 0, F.col(line_col)).cast("long")
    return rows.withColumn("__line", valid).join(lines.withColumnRenamed("line_num", "__line"), "__line", "left").drop("__line")


def encode_ids(pairs: DataFrame, id_col: str, ranges: int = 200) -> DataFrame:
    """Ids as dense integers in their order, from 0, through a table of the distinct ids. Rows without an id are left out.

    Ids are numbered within ranges, and ranges by the number of ids before them. The bounds are the ids of smallest hash, `ranges` at
    most, which one job fetches: any bounds give the same numbers, even ones only share the work.
    """
    ids = pairs.select(id_col).distinct().where(F.col(id_col).isNotNull())
    kind = pairs.schema[id_col].dataType
    bounds = [r[0] for r in ids.orderBy(F.xxhash64(id_col)).limit(ranges).collect()]
    known = F.array(*[F.lit(b).cast(kind) for b in bounds]).cast(ArrayType(kind))
    ids = ids.withColumn("__range", F.size(F.filter(known, lambda b: b < F.col(id_col))))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ids.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(id_col)) - 1
    numbers = ids.join(F.broadcast(firsts), "__range").select(id_col, (F.col("__first") + place).alias("label"))  # a row a range
    return pairs.join(numbers, id_col)


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a CSV file with at least these columns, texts over several lines too; a missing column is an error, rows that lack either value are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := {"id", "text"} - set(rows.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return rows.select("id", "text").where("id IS NOT NULL AND text IS NOT NULL")


def predictions_tsv(spark: SparkSession, path: str) -> DataFrame:
    """filename, label, start_span, end_span (whole numbers), text and note of a table with a header; empty strings stay, a bad number fails the read."""
    kinds = "filename string, label string, start_span int, end_span int, text string, note string"
    rows = spark.read.schema(kinds).option("header", True).option("sep", "\t").option("quote", '"').option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return rows.fillna("", ["filename", "label", "text", "note"])


#: Folders of the four classes in an annotated tree: fixed values.
TREE_CLASSES = ("dis", "med", "symp", "proc")


def span_tree(spark: SparkSession, root: str, lang: str, names: list[str] | None = None, checked: str = "1_validated_without_sugs", encoding: str = "UTF-8") -> DataFrame:
    """Spans below root/batch/checked/lang/class/tsv with the texts of dis/txt: (batch, class, name, tag, start_span, end_span, span, text).

    Of the given names only, if any are; spans without a text file are left out.
    """
    below = f"{root}/b*/{checked}/{lang}"
    batch = F.regexp_extract("_metadata.file_path", rf"/(b[^/]*)/{checked}/", 1).alias("batch")
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").option("recursiveFileLookup", True).csv([f"{below}/{c}/tsv/*.tsv" for c in TREE_CLASSES])
    rows = rows.select(batch, F.regexp_extract("_metadata.file_path", r"/([^/]+)/tsv/", 1).alias("class"), "name", "tag", F.col("start_span").cast("int").alias("start_span"), F.col("end_span").cast("int").alias("end_span"), F.coalesce("text", F.lit("")).alias("span"))
    texts = spark.read.format("binaryFile").load(f"{below}/dis/txt/*.txt").select(batch.alias("batch"), F.regexp_extract("path", r"/([^/]+)\.txt$", 1).alias("name"), F.decode("content", encoding).alias("text"))
    if names is not None:
        texts = texts.where(F.col("name").isin(names))
    return rows.join(texts, ["batch", "name"]).select("batch", "class", "name", "tag", "start_span", "end_span", "span", "text")


def listed_ids(spark: SparkSession, path: str) -> DataFrame:
    """The different ids of a `.txt` list, one a line, without `.txt` at the end; blank lines go."""
    if not path.endswith(".txt"):
        raise ValueError(f"{path} is no .txt file")
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"\.txt$", "").alias("id")).where("id <> ''").distinct()
