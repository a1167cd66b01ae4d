"""Article files: several articles a file, markup, missing parts, broken records."""

from strandlake.sources import articles

FILE = """<?xml version="1.0"?>
<PubmedArticleSet>
<PubmedArticle><MedlineCitation Status="x"><PMID Version="1">12</PMID><Article PubModel="P"><Journal><ISSN>1</ISSN><JournalIssue><PubDate><Year>1999</Year><Month>Jan</Month></PubDate></JournalIssue><Title>J. of X</Title></Journal>
<ArticleTitle>A <i>marked</i> title &amp; more, p &lt; 0.1 and q &gt; 2.</ArticleTitle><Abstract><AbstractText Label="AIM">One  two
 <b>bold</b><sup>2</sup> three.</AbstractText><AbstractText>Plain 1 &lt; 2</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author><Author></Author></AuthorList></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>13</PMID><Article><ArticleTitle>Only a title</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>14</PMID><Article><ArticleTitle>broken</Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><Article><ArticleTitle>no id</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>15</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2001 Spring-Summer</MedlineDate></PubDate></JournalIssue></Journal><Abstract><AbstractText>single</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>
"""


def test_articles_of_several_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FILE)
    (tmp_path / "b.xml").write_text("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>16</PMID></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>17</PMID><Arti")
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text("<PubmedArticleSet></PubmedArticleSet>")
    records = articles.article_files(spark, str(tmp_path))
    assert {tuple(r) for r in articles.articles(records).collect()} == {
        ("12", "A marked title & more, p < 0.1 and q > 2.", "AIM: One two bold2 three.\nPlain 1 < 2", "Doe, Jo; Group", "J. of X", "1999"),
        ("13", "Only a title", "", "", "", ""),
        ("15", "", "single", "", "", "2001"),
        ("16", "", "", "", "", ""),
    }
    broken = sorted(r.record for r in articles.failures(records).collect())
    assert len(broken) == 3 and "no id" in broken[0] and "<PMID>14<" in broken[1] and "<PMID>17<" in broken[2]


def test_escaped_text_comes_back(spark, tmp_path):
    odd = "a < b & \"c\" > 'd' &amp; <i>e</i> é 🙂"
    row = spark.createDataFrame([(odd,)], "t string").select(articles.escaped("t").alias("t")).first().t
    (tmp_path / "x.xml").write_text(f"<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>{row}</ArticleTitle></Article></MedlineCitation></PubmedArticle>")
    assert articles.articles(articles.article_files(spark, str(tmp_path))).first().title == odd
