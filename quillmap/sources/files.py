"""Documents from files, tables by content, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

TOKENS = "doc_id string, page int, text string, x double, y double, w double, h double, page_width double, page_height double"


def pdf_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Words of PDF files, one task row per file (needs pypdfium2 on the executors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pypdfium2 as pdfium

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                out = []
                for number, page in enumerate(pdfium.PdfDocument(data), 1):
                    width, height = page.get_size()
                    text, word, at = page.get_textpage(), "", None
                    for i in range(text.count_chars() + 1):
                        ch = text.get_text_range(i, 1) if i < text.count_chars() else " "
                        if ch.isspace():
                            if word:
                                x0, y0, x1, y1 = at
                                out.append((name, number, word, x0 / width, 1 - y1 / height, (x1 - x0) / width, (y1 - y0) / height, width, height))
                            word, at = "", None
                        else:
                            b = text.get_charbox(i)
                            word += ch
                            at = b if at is None else (min(at[0], b[0]), min(at[1], b[1]), max(at[2], b[2]), max(at[3], b[3]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in TOKENS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, TOKENS)


def by_content(files: DataFrame) -> DataFrame:
    """Binary files with the hash of their content and their place among equal ones (1 is worth reading)."""
    from pyspark.sql import Window

    keyed = files.withColumn("sha256", F.sha2("content", 256))
    return keyed.withColumn("copy", F.row_number().over(Window.partitionBy("sha256").orderBy("path")))


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table below ``path``: read if it is there, else written first.

    A folder without its success mark (a broken write) is written anew.
    """
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def citations(results: DataFrame) -> DataFrame:
    """(doc_id, citations): the results of a document as one JSON text."""
    one = F.struct("field", F.struct("page", F.array("box.x", "box.y", "box.w", "box.h").alias("bbox")).alias("place"), F.col("matched_text").alias("reference_text"), "confidence", "status")
    return results.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("citations"))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Sink: json, csv (with header) or parquet."""
    writer = df.write.mode("overwrite")
    writer = writer.option("header", True) if kind == "csv" else writer
    writer.format(kind).save(path)
