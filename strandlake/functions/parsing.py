"""Column expressions that parse identifiers, scores and loose JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tagged_publication(ids: Column | str) -> Column:
    """The number of the first 'pubmed:' token of a |-separated list, or null."""
    return F.nullif(F.regexp_extract(_c(ids), r"(?:^|\|)pubmed:([^|:]*)", 1), F.lit(""))


#: A token's symbol ends at a colon or at the mark that ends the token; a mark right before that colon is left out.
_TAGGED = r"(?:^|\|)uniprotkb:([^|:]*?)(?:(?:\(gene name\))?:[^|]*)?\(gene name\)(?:\||\z)"


def tagged_gene(aliases: Column | str) -> Column:
    """The symbol of the first 'uniprotkb:...(gene name)' token of a |-separated list, or null."""
    return F.nullif(F.regexp_extract(_c(aliases), _TAGGED, 1), F.lit(""))


def prefixed_publication(source: Column | str) -> Column:
    """The number behind a leading 'PUBMED:' (that case only), or null."""
    return F.when(_c(source).startswith("PUBMED:"), F.split_part(_c(source), F.lit(":"), F.lit(2)))


def role_name(rel: Column | str) -> Column:
    """A relationship type as a reaction role; types without a role name stay."""
    rel = _c(rel)
    return F.when(rel == "input", "reactant").when(rel == "catalystActivity", "catalyst").when(rel == "regulatedBy", "regulator").otherwise(rel)


def reply_score(reply: Column | str) -> Column:
    """The first 'score: <digits>' of a reply as a number, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(_c(reply), r"score:\s*(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def cited_names(text: Column | str) -> Column:
    """All names in PATHWAY_NAME:"..." marks, in order."""
    return F.regexp_extract_all(_c(text), F.lit('PATHWAY_NAME:"([^"]+)"'), F.lit(1))


def leading_names(text: Column | str) -> Column:
    """Per line the trimmed text before the first colon; a blank line gives ''."""
    return F.transform(F.split(_c(text), "\n"), lambda line: F.trim(F.split_part(line, F.lit(":"), F.lit(1))))


def flat_publications(lists: Column | str) -> Column:
    """The distinct ids of an array of |-joined id lists."""
    return F.array_distinct(F.flatten(F.transform(_c(lists), lambda x: F.split(x, r"\|"))))


def pdf_path(ref: Column | str, folder: str = "data/papers") -> Column:
    """A reference that ends in .pdf as it is, any other as a file of the folder."""
    ref = _c(ref)
    return F.when(F.lower(ref).endswith(".pdf"), ref).otherwise(F.concat(F.lit(f"{folder}/"), ref, F.lit(".pdf")))


def gene_or_default(gene: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(gene)), F.lit("")), F.lit("UNSPECIFIED_GENE"))


def search_string(gene: Column | str, grouped: bool = False) -> Column:
    """The literature search of a gene."""
    g = _c(gene)
    terms = F.concat(g, F.lit(" interactions or "), g, F.lit(" reactions or "), g, F.lit(" pathways"))
    return F.concat(F.lit("("), terms, F.lit(")")) if grouped else terms


def tool_search_string(gene: Column | str, more: Column | str | None = None) -> Column:
    """The search the literature tool sends: OR in capitals, further terms at the end if there are any."""
    g = _c(gene)
    terms = F.concat(g, F.lit(" interactions OR "), g, F.lit(" reactions OR "), g, F.lit(" pathways"))
    if more is None:
        return terms
    extra = F.coalesce(_c(more), F.lit(""))
    return F.when(extra != "", F.concat(terms, F.lit(" OR "), extra)).otherwise(terms)


def paper_record(pmid: Column | str, abstract: Column | str, **known: Column) -> Column:
    """pmid, title, abstract, authors, journal and year of a paper, '' where nothing is known."""
    given = {"pmid": _c(pmid), "abstract": _c(abstract), **known}
    return F.struct(*[F.coalesce(given.get(n, F.lit("")).cast("string"), F.lit("")).alias(n) for n in ("pmid", "title", "abstract", "authors", "journal", "year")])


def records_json(rows: DataFrame, group: str, columns: list[str], order: list[str], n: int) -> DataFrame:
    """group and the JSON list of its first n rows in this order, with these columns."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    kept = rows.withColumn("_nth", nth).where(F.col("_nth") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.struct(*columns).alias("r")))), lambda x: x["r"])
    return kept.groupBy(group).agg(F.to_json(listed).alias("records"), F.count("*").alias("n_records"))


def loose_records(text: Column | str) -> Column:
    """Kind of a model answer and its number of records: object (1), array, raw_text or unknown."""
    v = F.try_parse_json(_c(text))
    kind = F.schema_of_variant(v)
    what = F.when(v.isNull(), "raw_text").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("unknown")
    count = F.when(what == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))).otherwise(1)
    return F.struct(what.alias("kind"), count.cast("long").alias("records"))


def records_of(text: Column | str) -> Column:
    """The records of a model answer as an array of JSON texts.

    An object is one record, a list has one for each element, a text that is no JSON is {"content", "type": "raw_text"},
    any other JSON value {"content", "type": "unknown"}.
    """
    text = _c(text)
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    other = lambda what: F.array(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("content"), F.lit(what).alias("type"))))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x))
    return F.when(v.isNull(), other("raw_text")).when(kind.startswith("OBJECT"), F.array(F.to_json(v))).when(kind.startswith("ARRAY"), items).otherwise(other("unknown"))


def consensus_of(text: Column | str) -> Column:
    """decision, confidence and required revisions of the first record of a consensus.

    Where it is no object the decision is requires_revision at 0.5 with one revision that says so.
    """
    v = F.try_parse_json(_c(text))
    at = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    ok = F.coalesce(F.schema_of_variant(at).startswith("OBJECT"), F.lit(False))
    revisions = F.coalesce(F.try_variant_get(at, "$.required_revisions", "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.when(ok, F.try_variant_get(at, "$.decision", "string")).otherwise("requires_revision").alias("decision"),
        F.when(ok, F.try_variant_get(at, "$.confidence", "double")).otherwise(0.5).alias("confidence"),
        F.when(ok, revisions).otherwise(F.array(F.lit("The consensus is no readable JSON"))).alias("required_revisions"),
    )


def vote_of(text: Column | str) -> Column:
    """decision and confidence of the first record of a vote; unknown and 0.0 where it is no object."""
    v = F.try_parse_json(_c(text))
    at = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    ok = F.coalesce(F.schema_of_variant(at).startswith("OBJECT"), F.lit(False))
    decision = F.when(ok, F.coalesce(F.try_variant_get(at, "$.decision", "string"), F.lit("unknown"))).otherwise("unknown")
    confidence = F.when(ok, F.coalesce(F.try_variant_get(at, "$.confidence", "double"), F.lit(0.0))).otherwise(0.0)
    return F.struct(decision.alias("decision"), confidence.alias("confidence"))
