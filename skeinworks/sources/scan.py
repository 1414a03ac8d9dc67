"""Repository scans: which files are programs that a frontend reads, and what the others lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import seeds
from skeinworks.operators.reasoning import facts
from skeinworks.sources.lowering import lowered


def adapters(spark: SparkSession) -> DataFrame:
    """(extension, language, operational): a small fixed table."""
    return spark.createDataFrame(seeds.ADAPTERS, "extension string, language string, operational boolean")


def with_extensions(table: DataFrame, *extensions: tuple[str, str, bool]) -> DataFrame:
    """``table`` of adapters with more extensions, in any case and with or without a dot. An empty or known extension is an error."""
    known = {r.extension for r in table.collect()}  # a small fixed table
    new = [(e.lstrip(".").lower(), language, operational) for e, language, operational in extensions]
    for i, (e, *_) in enumerate(new):
        if not e:
            raise ValueError("NoExtensions")
        if e in known or e in {x[0] for x in new[:i]}:
            raise ValueError(f"DuplicateExtension: {e}")
    return table.unionByName(table.sparkSession.createDataFrame(new, table.schema)) if new else table


def with_adapter(paths: DataFrame, spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """``paths`` (source) with extension, language and error: MissingExtension, UnsupportedExtension or an unavailable frontend."""
    known = paths.withColumn("extension", F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)))
    joined = known.join(F.broadcast(adapters(spark) if table is None else table), "extension", "left")
    unavailable = F.concat(F.initcap("language"), F.lit(" frontend is unavailable: no frontend is built in"))
    error = F.when(F.col("extension") == "", "MissingExtension").when(F.col("language").isNull(), "UnsupportedExtension").when(~F.col("operational"), unavailable)
    return joined.withColumn("error", error)


def _outside_skipped(root: str) -> Column:
    """The path below ``root`` is in none of the skipped folders, whatever folders ``root`` itself lies in."""
    below = F.regexp_replace("source", r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    folders = "|".join(x.replace(".", r"\.") for x in seeds.SKIPPED_FOLDERS)
    return ~F.substring(below, len(base), 1 << 20).rlike(f"/({folders})/")


def repository(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root`` (an absolute path) outside the skipped folders: source, extension, language, error.

    Only paths are read; symbolic links are followed by the file system alone.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("source"))
    return with_adapter(listed.filter(_outside_skipped(root)), spark)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """The files of ``repository`` that a frontend may read: source, language, content.

    JSON is what its content says: a transport document, the methods of a Java source, Clang's tree of a C source, or
    nothing of ours. Java, C and transport sources themselves need a compiler, whose JSON is read in their place.
    """
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,pyw,json,PY,PYW,JSON}")
    files = named.load(root).select(F.col("path").alias("source"), "content")
    known = with_adapter(files.filter(_outside_skipped(root)), spark).filter("error IS NULL AND extension IN ('py', 'pyw', 'json')")
    read = known.withColumn("content", F.decode("content", "UTF-8"))
    document = F.try_parse_json(F.when(F.col("extension") == "json", F.col("content")))
    form, kind, methods = (F.try_variant_get(document, f"$.{x}", t) for x, t in (("format", "string"), ("kind", "string"), ("methods", "variant")))
    language = F.when(F.col("extension") != "json", "python").when(form.endswith(".semantic-export"), "transport").when(kind == "TranslationUnitDecl", "c").when(methods.isNotNull(), "java")
    return read.withColumn("language", language).filter("language IS NOT NULL").select("source", "language", "content")


def visits(files: DataFrame) -> DataFrame:
    """Visits of ``files`` (source, language, content), each by the frontend of its language; a source that its frontend rejects is a row of kind error."""
    return lowered(files)


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """(source, reason) of the files of a known language that no frontend reads."""
    compiled = F.concat(F.initcap("language"), F.lit(" sources need a compiler: give the JSON that it emits"))
    reason = F.coalesce("error", F.when(F.col("extension").isin("java", "c", "ving"), compiled))
    left = repository(spark, root).filter("NOT error <=> 'MissingExtension' AND NOT error <=> 'UnsupportedExtension'")
    return left.withColumn("reason", reason).filter("reason IS NOT NULL").select("source", "reason")


def repository_facts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(facts of all functions, skipped: source and reason). Files of no known language are neither."""
    seen = visits(contents(spark, root))
    rejected = seen.filter("kind = 'error'").select("source", F.col("error").alias("reason"))
    return facts(seen.filter("kind NOT IN ('error', 'empty')")), skipped(spark, root).unionByName(rejected)
