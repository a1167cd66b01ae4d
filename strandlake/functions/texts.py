"""Prompt and context columns; wording is this package's own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import parts

TEMPLATES = {
    "pathway_text": "Title of the pathway: {name}\n\nSummary of the pathway: {summary}",
    "role_section": "\n\nRoles of the gene in its reactions: {roles}",
    "annotated_pathway": "Describe in at most {words} words what gene {gene} does in the pathway below, by its roles only.\n{text}",
    "annotated_pathways": "Combine the pathway descriptions of gene {gene} below into one account of at most {words} words.\n{text}",
    "interacting_pathway": "Partners {partners} of gene {gene} act in the pathway below, in these roles: {roles}. Explain how {gene} may take part.\n{text}",
    "interacting_pathways": "Rank the pathways gene {gene} (partners {partners}) may belong to, given names with their false-discovery rates.\n{fdrs}\n{text}",
    "abstract_match": "Rate from 0 to 10 how well the abstract supports the pathway text; answer with 'score: <number>'.\n{text}",
    "abstract_summary": "Summarise what the abstracts say about gene {gene} in this pathway; cite each PMID.\n{text}",
    "abstracts_summary": "Summarise over all pathways of gene {gene} and its partners {partners}; mark names as PATHWAY_NAME:\"<name>\".\n{text}",
    "interaction_summary": "Summarise what the abstracts say about interactions between {gene} and {partners} in the pathway {pathway}.\n{text}",
    "relationships": "List the relationships in the text as 'gene - type -> other', one a line.\n{text}",
    "extraction_task": "Collect what papers say about gene {gene}: interactions, pathways and functions, as JSON. Way of working: {branch}.",
    "curation_task": "Turn what was extracted about gene {gene} into entities, reactions and pathways, as JSON.\nExtracted: {extraction}",
    "review_task": "Rate the records of gene {gene} by accuracy, completeness, evidence and consistency; approve from {threshold} on.\nRecords: {curation}",
    "qa_task": "Check the records of gene {gene} by compliance, integrity, citations and consistency; approve from {threshold} on.\nRecords: {curation}\nReview: {review}",
    "vote_task": "Vote as {agent} on gene {gene}: approve, requires_revision or reject, as JSON.\nExtraction: {extraction}\nCuration: {curation}\nReview: {review}\nCheck: {qa}",
    "consensus_task": "Draw the decision on gene {gene} from the votes by the fixed rules.\nVotes: {votes}",
}
#: A task shows at most so many characters of each earlier context.
CONTEXT = 4000


def render(template: str, **values: Column | str) -> Column:
    """A template with its {placeholders} replaced by columns (strings are literals)."""
    return _put(TEMPLATES[template], values)


def around(template: str, hole: str, **values: Column | str) -> tuple[Column, Column]:
    """What a rendered template has before and after one of its placeholders."""
    before, after = TEMPLATES[template].split("{" + hole + "}")
    return _put(before, values), _put(after, values)


def _put(text: str, values: dict[str, Column | str]) -> Column:
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce((F.lit(value) if isinstance(value, str) else value).cast("string"), F.lit("")))
    return out


def task(template: str, contexts: dict[str, Column], **values: Column | str) -> Column:
    """The text of a task; of each context the first CONTEXT characters are shown."""
    return render(template, **values, **{name: F.left(F.coalesce(c, F.lit("")), F.lit(CONTEXT)) for name, c in contexts.items()})


def _block() -> Column:
    return F.concat(F.lit("PMID "), F.col("pmid"), F.lit(":"), F.col("abstract"), F.lit("\n\n"))


def abstracts_digest(rows: DataFrame, group: str, before: Column, after: Column, order: str = "pmid") -> DataFrame:
    """Per group (a string) n_chars and MD5 digest of before, its abstracts_context and after, whatever their length, and n_abstracts.

    No group is gathered: its blocks are sorted, which spills, and pass one by one through a running digest. A digest runs
    from the first block to the last, so a group is one task's work, but never in its memory.
    """
    dealt = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), before.alias("head"), after.alias("tail"), _block().alias("b")).repartition(parts(rows), "g")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: list = []  # of the group that runs: its name, characters, blocks, digest and end

        def done() -> pd.DataFrame:
            g, chars, blocks, running, end = at
            running.update(end.encode())
            return pd.DataFrame({"g": pd.Series([g], dtype=object), "n_chars": [chars + len(end)], "n_abstracts": [blocks], "digest": [running.hexdigest()]})

        for pdf in batches:
            for g, head, end, block in zip(pdf["g"], pdf["head"], pdf["tail"], pdf["b"], strict=True):
                if not at or g != at[0]:
                    if at:
                        yield done()
                    at[:] = [g, len(head), 0, hashlib.md5(head.encode()), end]
                if block is not None:
                    at[1] += len(block)
                    at[2] += 1
                    at[3].update(block.encode())
        if at:
            yield done()

    ordered = dealt.sortWithinPartitions("g", F.col("o").asc_nulls_last(), "b").select("g", "head", "tail", "b")
    return ordered.mapInPandas(digests, "g string, n_chars long, n_abstracts long, digest string").withColumnRenamed("g", group)


def abstracts_context(rows: DataFrame, group: str, order: str = "pmid") -> DataFrame:
    """Per group 'PMID <id>:<abstract>' blocks in order, each followed by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), _block().alias("b"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("context"))


def relationships(text: Column) -> Column:
    """Array of (gene, type, other) of all 'gene - type -> other' lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\S.*? - .+? -> .+$"))
    part = lambda x, i: F.trim(F.regexp_extract(x, r"^\s*(\S.*?) - (.+?) -> (.+)$", i))
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("gene"), part(x, 2).alias("type"), part(x, 3).alias("other")))
