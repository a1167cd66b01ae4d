"""Article files in XML: many articles a file, read with an explicit schema; broken records are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the parts of the exchange format that are read.
ARTICLE_SCHEMA = """MedlineCitation struct<PMID: string, Article: struct<
    Journal: struct<JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>, Title: string>,
    ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>,
    AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, CollectiveName: string>>>>>, _corrupt string"""


def _plain(text: Column) -> Column:
    """Text without blanks at its ends and runs of blanks."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Marks inside a text that say how it looks.
INLINE = "i b u em strong sup sub".split()


def article_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all article files of a path: the citation, or the record's text in _corrupt if it can't be read.

    A file may hold any number of articles. It is cut at their ends, so Spark splits large files between articles, and a
    broken record takes no other with it. What stands before, between and after articles is not read; of a file that
    ends inside an article that one is broken.
    """
    pieces = spark.read.option("lineSep", "</PubmedArticle>").text(path)
    record = F.concat(F.regexp_extract("value", r"(?s)<PubmedArticle[\s>].*", 0), F.lit("</PubmedArticle>"))
    record = F.regexp_replace(record, rf"</?({'|'.join(INLINE)})(\s[^>]*)?>", "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = pieces.where(F.col("value").rlike(r"<PubmedArticle[\s>]")).select(F.from_xml(record, ARTICLE_SCHEMA, options).alias("r"), record.alias("_record"))
    broken = F.col("r.MedlineCitation.PMID").isNull()
    return rows.select("r.MedlineCitation", F.when(broken, F.col("_record")).alias("_corrupt"))


def articles(records: DataFrame) -> DataFrame:
    """pmid, title, abstract, authors, journal and year of the records that could be read.

    The parts of an abstract stand on lines of their own, `LABEL: text` where a part has a label; authors are joined by
    '; ', each a last name, a comma and first names, or a group's name. The year is that of the issue or the first four
    digits of its free date. What is missing is an empty text.
    """
    c = F.col("MedlineCitation")
    a = c["Article"]
    none = F.lit("")
    part = lambda p: F.concat(F.coalesce(F.concat(p["_Label"], F.lit(": ")), none), _plain(F.coalesce(p["_VALUE"], none)))
    name = lambda p: F.coalesce(F.concat_ws(", ", p["LastName"], p["ForeName"]), none)
    people = F.transform(a["AuthorList"]["Author"], lambda p: F.when(F.length(name(p)) > 0, name(p)).otherwise(p["CollectiveName"]))
    issued = a["Journal"]["JournalIssue"]["PubDate"]
    year = F.coalesce(issued["Year"], F.regexp_extract(issued["MedlineDate"], r"\d{4}", 0))
    said = {
        "pmid": c["PMID"],
        "title": _plain(a["ArticleTitle"]),
        "abstract": F.array_join(F.transform(a["Abstract"]["AbstractText"], part), "\n"),
        "authors": F.array_join(F.filter(people, lambda p: F.length(p) > 0), "; "),
        "journal": _plain(a["Journal"]["Title"]),
        "year": year,
    }
    return records.where(F.col("_corrupt").isNull()).select(*[F.coalesce(v, none).alias(k) for k, v in said.items()])


def failures(records: DataFrame) -> DataFrame:
    """record: the text of every record that could not be read, or has no id."""
    return records.where(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("record"))


def escaped(text: Column | str) -> Column:
    """Text as the content of an element."""
    out = F.col(text) if isinstance(text, str) else text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out
