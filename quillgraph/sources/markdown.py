"""Markdown graph files and other file sources and sinks."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.frontmatter import EDGE_FIELDS, node_fields
from quillgraph.sources.schema import ENTRY_DDL

#: Opening fence, front matter, closing fence on a line of its own, body after one newline.
FRONT = r"(?s)\A\s*---[ \t]*\r?\n(.*?)\n---[ \t]*(?:\r?\n(.*))?\z"


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """(file_path, content) of all *.md files below a first level of folders; files in ``directory`` itself are no nodes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    root = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(directory, wholetext=True)
    inner = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^[a-z0-9]+:/+", "/")
    below = F.substring(inner, F.length(F.regexp_replace(F.lit(root), "^[a-z0-9]+:/+", "/")) + 2, 1 << 20)
    return files.filter(below.contains("/")).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))


def _read(files: DataFrame) -> DataFrame:
    """(file_path, content, body, front, f): the file's halves and the fields of its front matter."""
    close = F.locate("\n---", F.col("content"), 5)
    bare = F.startswith("content", F.lit("---\n")) & (close > 0) & (F.substr("content", close + 4, F.lit(1)) == "\n")  # bare fences are found without the pattern
    front = F.when(bare, F.substr("content", F.lit(5), close - 5)).otherwise(F.regexp_extract("content", FRONT, 1))
    body = F.when(bare, F.substr("content", close + 5)).otherwise(F.coalesce(F.regexp_extract("content", FRONT, 2), F.lit("")))
    halves = F.inline(F.array(F.struct(front.alias("front"), body.alias("body"))))  # a generator, so that no field cuts the file again
    return files.select("file_path", "content", halves).withColumn("f", node_fields(F.col("front")))


def parse(files: DataFrame) -> DataFrame:
    """NODES rows of (file_path, content). A file is left to :func:`rejected` if its front matter is none or not well
    formed, lacks an id or type, has an edge without target or type, or a date or time that is none."""
    f = F.col("f")
    return _read(files).filter("f.problem is null").select(
        f["id"].alias("id"),
        f["type"].alias("node_type"),
        *[f[c].alias(c) for c in ("status", "owner")],
        *[F.try_to_timestamp(f[c]).alias(c) for c in ("created", "updated")],
        f["tags"].alias("tags"),
        F.transform(f["edges"], lambda e: e.withField("valid_from", e["valid_from"].cast("date")).withField("valid_until", e["valid_until"].cast("date"))).alias("edges"),
        T.title(F.col("body"), f["id"]).alias("title"),
        "body",
        "file_path",
        T.content_hash(F.col("body")).alias("content_hash"),
    )


def rejected(files: DataFrame) -> DataFrame:
    """(file_path, content, problem) of files that hold no node."""
    return _read(files).select("file_path", "content", F.when(F.col("front") == "", "no front matter").otherwise(F.col("f.problem")).alias("problem")).filter("problem is not null")


def unique(nodes: DataFrame) -> DataFrame:
    """Of nodes with one id the one of the greatest path stays."""
    return nodes.groupBy("id").agg(F.max_by(F.struct(*nodes.columns), "file_path").alias("n")).select("n.*")


#: Texts that a plain scalar cannot hold, or that would be read as another type.
UNSAFE = r"(?is)\A(?:|[\s\-?:,\[\]{}#&*!|>'\"%@`].*|.*[\s:]|.*(?:: | #|:\t|\t#|[\[\]{},]).*|~|null|true|false|yes|no|on|off|[-+.]?[0-9][0-9a-f_.:+-]*)\z"
#: Texts that a plain scalar holds for certain: letters first, no words of another type.
SAFE = r"\A(?!(?i:null|true|false|yes|no|on|off)\z)[A-Za-z][A-Za-z0-9_./+-]*\z"
BREAKS = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\x85": "\\N", "\u2028": "\\L", "\u2029": "\\P"}


def scalar(value: Column) -> Column:
    """A text as a YAML scalar: plain where that is read back as the same text, quoted otherwise."""
    double = value
    for found, escape in BREAKS.items():
        double = F.replace(double, F.lit(found), F.lit(escape))
    single = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.rlike(SAFE), value).when(value.rlike("[\n\r\t\x85\u2028\u2029]"), F.concat(F.lit('"'), double, F.lit('"'))).when(value.rlike(UNSAFE), single).otherwise(value)


def serialise(nodes: DataFrame) -> DataFrame:
    """S3: (id, content): front matter in a fixed order, then the body; :func:`parse` reads the same node back."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # null where the value is
    moment = lambda name: line(name, F.date_format(name, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    fields = lambda e: (scalar(e["target"]), scalar(e["type"]), e["valid_from"].cast("string"), e["valid_until"].cast("string"), scalar(e["annotation"]))
    edge = lambda e: F.concat_ws("\n", *[line(f"{'    ' if k else '  - '}{name}", value) for k, (name, value) in enumerate(zip(EDGE_FIELDS, fields(e)))])
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        line("id", scalar(F.col("id"))),
        line("type", scalar(F.col("node_type"))),
        line("status", scalar(F.col("status"))),
        *[moment(c) for c in ("created", "updated") if c in nodes.columns],
        line("owner", scalar(F.col("owner"))),
        F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join(F.transform("tags", scalar), ", "), F.lit("]"))),
        F.when(F.size("edges") > 0, F.concat(F.lit("edges:\n"), F.array_join(F.transform("edges", edge), "\n"))),
        F.lit("---"),
    )
    return nodes.select("id", F.concat(head, F.lit("\n"), F.coalesce("body", F.lit(""))).alias("content"))


def flatten(nodes: DataFrame) -> DataFrame:
    """EDGES rows of nested edges; of one (source, target, type) the first stays."""
    e = nodes.select(F.col("id").alias("source_id"), F.posexplode("edges").alias("edge_idx", "e")).select("source_id", "edge_idx", F.col("e.target").alias("target_id"), F.col("e.type").alias("edge_type"), "e.valid_from", "e.valid_until", "e.annotation")
    return e.groupBy("source_id", "target_id", "edge_type").agg(F.min_by(F.struct("edge_idx", "valid_from", "valid_until", "annotation"), "edge_idx").alias("m")).select("source_id", "m.edge_idx", "target_id", "edge_type", "m.valid_from", "m.valid_until", "m.annotation")


def journal(spark: SparkSession, directory: str) -> DataFrame:
    """Entries of JSON lines; a corrupt line keeps its text in ``_corrupt``."""
    return spark.read.schema(ENTRY_DDL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(directory)


def sections(spark: SparkSession, toml_text: str) -> DataFrame:
    """The sections of a template, in order."""
    data = tomllib.loads(toml_text)
    rows = [(data.get("name"), k, x.get("heading"), x.get("traverse"), x.get("target_type"), x.get("filter", {}).get("status", [])) for k, x in enumerate(data.get("sections", []))]
    return spark.createDataFrame(rows, "template string, ordinal int, heading string, edge_type string, target_type string, statuses array<string>")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object for each row, nulls written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def import_texts(files: DataFrame, node_type: str) -> DataFrame:
    """A draft root for each plain text (file_path, content): id from its first line."""
    first = T.first_line(F.col("content"))
    return files.select(F.concat(F.lit(f"{node_type}-"), T.slug(first)).alias("id"), F.lit(node_type).alias("node_type"), F.lit("draft").alias("status"), first.alias("title"), F.col("content").alias("body"), "file_path")
