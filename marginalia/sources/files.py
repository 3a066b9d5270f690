"""Readers and writers of the text formats: label files, tagged sections, name lists, register rows, charter JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import MIDDLE_DOT, WS, clean_text, numeric_order, split_words, strip
from marginalia.operators.corpus import sections
from marginalia.operators.spans import conll_documents
from marginalia.operators.tokens import edition_texts

CHARTER = "Id string, Date string, Place string, Language string, Summary string, Edition string, source string"
REGISTER = "Id string, Lang string, Edition string, Date string"


def charters(spark: SparkSession, path: str) -> DataFrame:
    """One top-level JSON array a file; ids as text, missing keys null."""
    return spark.read.schema(CHARTER).json(path, multiLine=True)


def register(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a header, parted by semicolons, in Latin-1; quoted fields may hold line ends."""
    rows = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1", multiLine=True, escape='"')
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ("Id", "Lang", "Edition", "Date")])


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: name and whole text of each file, without a byte-order mark and with plain line ends."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"^\x{feff}", ""), "\r\n?", "\n"))


def file_id(file: Column) -> Column:
    """The second part of names like ``sdhk_<id>_gold.conll``."""
    return F.get(F.split(F.regexp_replace(file, r"\.[^.]*$", ""), "_"), F.lit(1))


def discover(files: DataFrame) -> DataFrame:
    """``doc_id, file, value`` of ``*.conll`` files; of two with one id the later name stays."""
    rows = files.where(F.col("file").rlike(r"^[^_]*_.*\.conll$")).withColumn("doc_id", file_id(F.col("file")))
    latest = Window.partitionBy("doc_id").orderBy(F.desc("file"))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("doc_id", "file", "value")


def verified_ids(files: DataFrame, suffix: str = "silver") -> DataFrame:
    return files.select(F.regexp_extract("file", rf"^[^_]*_(.+)_{suffix}\.conll$", 1).alias("doc_id")).where("doc_id <> ''").distinct()


def _lines(docs: DataFrame) -> DataFrame:
    value = F.regexp_replace("value", r"\n\z", "")
    return docs.select("doc_id", F.posexplode(F.split(value, "\n", -1)).alias("line_no", "line"))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return rows.withColumn("idx", F.row_number().over(order) - 1)


def read_entities_form(docs: DataFrame) -> DataFrame:
    """``doc_id, idx, text, label, sent_id`` of ``doc_id, value``: lines stripped and split at white space, first part and last; lines of one part are skipped."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # most lines are a token, one space and a label, and are cut there; the other patterns are for the rest
    plain = F.col("line").rlike("^[!-~]+ [!-~]+$")
    rows = _lines(docs).withColumn("_plain", plain).withColumn("line", F.when(F.col("_plain"), F.col("line")).otherwise(strip(F.col("line"))))
    rows = rows.withColumn("sent_id", F.count_if(F.col("line") == "").over(so_far)).withColumn("p", F.when(~F.col("_plain"), split_words(F.col("line")))).where(F.col("_plain") | (F.size("p") >= 2))
    part = lambda n: F.when(F.col("_plain"), F.substring_index("line", " ", n)).otherwise(F.element_at("p", n))
    return _numbered(rows).select("doc_id", "idx", part(1).alias("text"), part(-1).alias("label"), "sent_id")


def read_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_id, pos, text, label``: only empty lines part sentences, a tab parts token and label, else the last white space; middle dots are dropped, and sentences of nothing else."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(docs).withColumn("breaks", F.count_if(F.col("line") == "").over(so_far)).where("line <> ''")
    line, trimmed = F.col("line"), F.regexp_replace("line", rf"[{WS}]+$", "")
    tab = F.contains(line, F.lit("\t"))
    at = F.when(tab, F.instr(line, "\t"))
    # most lines are a token, one space and a label, and are cut there; the patterns are for the others
    last = F.substring_index(line, " ", -1)
    head = F.substr(line, F.lit(1), F.length(line) - F.length(last) - 1)
    plain = ~tab & F.contains(line, F.lit(" ")) & last.rlike("^[!-~]+$") & F.right(head, F.lit(1)).rlike(f"[^{WS}]")
    text = F.when(plain, head).when(tab, F.substr(line, F.lit(1), at - 1)).otherwise(F.regexp_extract(trimmed, rf"(?s)^(.*?)[{WS}]+[^{WS}]+$", 1))
    label = F.when(plain, last).when(tab, F.substr(line, at + 1)).otherwise(F.regexp_extract(trimmed, rf"[^{WS}]+$", 0))
    two = plain | tab | strip(line).rlike(f"[{WS}]")
    rows = rows.where(two).select("doc_id", "line_no", "breaks", text.alias("text"), label.alias("label")).where(F.col("text") != MIDDLE_DOT)
    # sentences and places are counted in the order of the lines, which the breaks were counted in
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumns({"_n": F.row_number().over(order), "_opens": ~F.coalesce(F.lag("breaks").over(order) == F.col("breaks"), F.lit(False))})
    sentence, first = F.count_if("_opens").over(so_far).cast("int") - 1, F.last(F.when(F.col("_opens"), F.col("_n")), ignorenulls=True).over(so_far)
    return rows.select("doc_id", sentence.alias("sent_id"), (F.col("_n") - first).alias("pos"), "text", "label")


def flatten(sentences: DataFrame) -> DataFrame:
    """Sentences as one sequence: ``doc_id, idx, text, label``."""
    order = Window.partitionBy("doc_id").orderBy("sent_id", "pos")
    return sentences.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "text", "label")


def merge(parts: list[DataFrame]) -> DataFrame:
    """Sentence tables one after the other: ``file_no`` first."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("file_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def name_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of a list of names; files are small, their lines are numbered in order."""
    return whole_files(spark, path).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def name_rows(spark: SparkSession, path: str) -> DataFrame:
    """``row_no, fields`` of a two-column name table without a header."""
    rows = spark.read.csv(path, header=False, multiLine=True, escape='"')
    numbered = rows.withColumn("row_no", F.monotonically_increasing_id())
    return numbered.select("row_no", F.array(*[F.coalesce(F.col(c), F.lit("")) for c in rows.columns]).alias("fields"))


def annotator_sections(spark: SparkSession, path: str) -> DataFrame:
    """``file, section_no, charter_id, section, body``."""
    return sections(whole_files(spark, path))


def gold_editions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``doc_id, text`` of annotators' sections, tags taken out and cleaned; a later file's text replaces an earlier one's."""
    return section_texts(merge([annotator_sections(spark, p) for p in paths]))


def section_texts(parts: DataFrame) -> DataFrame:
    """The same of sections (``file_no, file, section_no, charter_id, body``)."""
    from marginalia.operators.corpus import tagged_spans

    plain = tagged_spans(parts, "body")
    latest = F.max_by("plain", F.struct("file_no", "file", "section_no"))
    return plain.groupBy(F.col("charter_id").alias("doc_id")).agg(latest.alias("plain")).select("doc_id", clean_text(F.col("plain")).alias("text"))


def charter_editions(spark: SparkSession, path: str, strip_middle_dots: bool = True) -> DataFrame:
    return edition_texts(charters(spark, path), "Id", "Edition", strip_middle_dots)


def write_conll(labels: DataFrame, path: str) -> None:
    """A folder for each document, named by its id, with one label file."""
    conll_documents(labels).withColumn("value", F.regexp_replace("value", r"\n\z", "")).write.partitionBy("doc_id").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def review_texts(unknown: DataFrame) -> DataFrame:
    """``doc_id, n, value``: each document's unknown capitalised tokens as text, by first sight."""
    rows = unknown.withColumn("line", F.concat(F.lit("  "), F.col("text"), F.when(F.col("n") > 1, F.concat(F.lit("  (x"), F.col("n"), F.lit(")"))).otherwise("")))
    docs = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first_idx", "line"))).alias("l"))
    return docs.select("doc_id", "n", F.concat(F.lit("--- "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("n"), F.lit(" tokens) ---\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def write_review(unknown: DataFrame, path: str) -> None:
    """The texts of ``review_texts`` (in the order of numeric ids where they are numbers), then totals."""
    docs = review_texts(unknown)
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("d")).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("n"), F.concat(F.lit("Total: "), F.col("n"), F.lit(" tokens in "), F.col("d"), F.lit(" documents")).alias("value"))
    docs.unionByName(total).orderBy(F.col("doc_id").isNull(), *numeric_order(F.col("doc_id"))).select("value").write.text(path)


def write_split(spark: SparkSession, source: str, out: str, seed: int = 42) -> dict:
    """Split a folder's label files by a seeded shuffle of their names; the test files' texts and a manifest go to ``out``.

    Only names come to the driver, where the shuffle's generator is; the test files are
    found by a join with theirs. The manifest is also returned.
    """
    import json

    from marginalia.operators.corpus import split_by_shuffle

    docs = whole_files(spark, source)
    names = [r.file for r in docs.select("file").distinct().collect()]
    parts = split_by_shuffle(names, seed)
    manifest = {"seed": seed, "source_dir": source, "output_dir": out, **parts}
    test = spark.createDataFrame([(name,) for name in parts["test"]], "file string")
    docs.join(test, "file", "left_semi").withColumn("value", F.regexp_replace("value", r"\n\z", "")).write.partitionBy("file").text(f"{out}/test")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{out}/manifest")
    return manifest
