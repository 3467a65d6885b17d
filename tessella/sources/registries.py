"""Sources from the answers of three registries: clinical studies, papers and encyclopedia articles. An answer is JSON text; each record with what it needs is a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import register

LISTED, AUTHORS = 8, 12
STUDIES = """struct<studies: array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>, statusModule: struct<overallStatus: string>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>, conditionsModule: struct<conditions: array<string>>, armsInterventionsModule: struct<interventions: array<struct<name: string>>>,
  designModule: struct<studyType: string, phases: array<string>, enrollmentInfo: struct<count: bigint>>, descriptionModule: struct<briefSummary: string>>>>>"""
PAPERS = "struct<data: array<struct<title: string, abstract: string, authors: array<struct<name: string>>, year: int, venue: string, citationCount: bigint, tldr: struct<text: string>, externalIds: struct<DOI: string>, url: string, paperId: string>>>"
ARTICLES = "struct<query: struct<pages: array<struct<title: string, extract: string, index: bigint>>>>"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def listed(values: Column, most: int = LISTED) -> Column:
    """The first of some values that say anything."""
    return F.slice(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), collapsed), lambda x: x != ""), 1, most)


def said(lead: str, value: Column) -> Column:
    """A line for a value, none without it."""
    return F.when(value != "", F.concat(F.lit(lead), value))


def content(title: Column, authors: Column | None, meta: list[Column], abstract: Column) -> Column:
    """Title, authors and what is known, line by line, and behind an empty line the abstract."""
    names = said("Authors: ", F.array_join(authors, ", ")) if authors is not None else F.lit(None).cast("string")
    head = F.array_join(F.array_compact(F.array(title, names, *meta)), "\n")
    return F.concat(head, F.when(abstract != "", F.concat(F.lit("\n\n"), abstract)).otherwise(""))


def study_sources(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, url, title, text) of the studies of each answer that have a number and a title."""
    rows = answers.select(key, F.posexplode(F.from_json(body, STUDIES)["studies"]).alias("place", "s")).select(key, "place", "s.protocolSection.*")
    number = collapsed(F.col("identificationModule.nctId"))
    title = collapsed(F.coalesce("identificationModule.briefTitle", "identificationModule.officialTitle"))
    plain = lambda c: F.regexp_replace(c, "_", " ")
    kind = F.array_join(F.filter(F.array(collapsed(F.col("designModule.studyType")), F.array_join(F.transform(listed(F.col("designModule.phases")), plain), "/")), lambda x: x != ""), " · ")
    meta = [
        said("Status: ", plain(collapsed(F.col("statusModule.overallStatus")))), said("", kind), said("Conditions: ", F.array_join(listed(F.col("conditionsModule.conditions")), ", ")),
        said("Interventions: ", F.array_join(listed(F.transform("armsInterventionsModule.interventions", lambda i: i["name"])), ", ")), said("Sponsor: ", collapsed(F.col("sponsorCollaboratorsModule.leadSponsor.name"))),
        F.concat(F.lit("Enrollment: "), F.col("designModule.enrollmentInfo.count").cast("string")),
    ]
    text = content(title, None, meta, collapsed(F.col("descriptionModule.briefSummary")))
    return rows.where((number != "") & (title != "")).select(key, "place", F.concat(F.lit("https://clinicaltrials.gov/study/"), number).alias("url"), title.alias("title"), text.alias("text"))


def paper_sources(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, url, title, text) of the papers of each answer that have a title and an address: by DOI, else their own, else by id."""
    rows = answers.select(key, F.posexplode(F.from_json(body, PAPERS)["data"]).alias("place", "p")).select(key, "place", "p.*")
    doi = F.trim(F.regexp_replace(F.coalesce("externalIds.DOI", F.lit("")), "(?i)^doi:", ""))
    url = F.when(F.trim(F.coalesce("externalIds.DOI", F.lit(""))) != "", F.concat(F.lit("https://doi.org/"), doi)).when(F.col("url").rlike("^https?://"), F.col("url")).when(F.coalesce("paperId", F.lit("")) != "", F.concat(F.lit("https://www.semanticscholar.org/paper/"), "paperId"))
    title, venue = collapsed(F.col("title")), collapsed(F.col("venue"))
    year = F.when(F.col("year") != 0, F.concat(F.lit("("), F.col("year").cast("string"), F.lit(")")))
    meta = [F.nullif(F.concat_ws(" ", F.nullif(venue, F.lit("")), year), F.lit("")), F.concat(F.lit("Cited by "), F.col("citationCount").cast("string")), said("TL;DR: ", collapsed(F.col("tldr.text")))]
    text = content(title, listed(F.transform("authors", lambda a: a["name"]), AUTHORS), meta, collapsed(F.col("abstract")))
    return rows.where((title != "") & url.isNotNull()).select(key, "place", url.alias("url"), title.alias("title"), text.alias("text"))


def article_sources(answers: DataFrame, key: str, body: str, lang: str = "en") -> DataFrame:
    """(key, place, url, title, text) of the articles of each answer that have a title and an introduction, by the index that the search gave them."""
    pages = F.filter(F.from_json(body, ARTICLES)["query"]["pages"], lambda p: (F.coalesce(p["title"], F.lit("")) != "") & (collapsed(p["extract"]) != ""))
    rows = answers.select(key, F.posexplode(F.array_sort(F.transform(pages, lambda p, i: F.struct(F.coalesce(p["index"], F.lit(0)).alias("at"), i.alias("i"), p["title"].alias("title"), collapsed(p["extract"]).alias("extract"))))).alias("place", "p"))
    coded = F.regexp_replace(F.url_encode(F.regexp_replace(F.col("p.title"), " ", "_")), r"\+", "%20")
    for code, letter in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):  # what a browser leaves as it is
        coded = F.replace(coded, F.lit(code), F.lit(letter))
    return rows.select(key, "place", F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), coded).alias("url"), F.col("p.title").alias("title"), content(F.col("p.title"), None, [], F.col("p.extract")).alias("text"))


def manifests(asked: DataFrame, sources: DataFrame, tool: str, key: str, query: str) -> DataFrame:
    """(key, reply): what the tool says of each query: the titles that it submitted, or that there were none."""
    titles = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("t"))  # one answer's, a page of results
    joined = asked.join(titles, key, "left")
    lines = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["title"])), "\n")
    found = F.concat(F.lit(f"{tool}: found "), F.size("t").cast("string"), F.lit(' result(s) for "'), F.col(query), F.lit('"; submitted as sources:\n'), lines)
    return joined.select(key, F.when(F.coalesce(F.size("t"), F.lit(0)) < 1, F.concat(F.lit(f'{tool}: no results for "'), F.col(query), F.lit('"'))).otherwise(found).alias("reply"))


def _studies(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    one = F.struct(F.struct(
        F.struct(F.when(i % 7 > 0, F.concat(F.lit("NCT"), i)).alias("nctId"), F.when(i % 3 > 0, F.concat(F.lit(" A  title "), i)).alias("briefTitle"), F.concat(F.lit("Official "), i).alias("officialTitle")).alias("identificationModule"),
        F.struct(F.when(i % 2 == 0, "NOT_YET_RECRUITING").alias("overallStatus")).alias("statusModule"), F.struct(F.struct(F.col("source").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(F.transform(F.sequence(F.lit(1), (i % 10 + 1).cast("int")), lambda k: F.concat(F.lit("c"), k)).alias("conditions")).alias("conditionsModule"), F.struct(F.array(F.struct(F.lit("drug  x").alias("name")), F.struct(F.lit(" ").alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
        F.struct(F.lit("INTERVENTIONAL").alias("studyType"), F.when(i % 5 > 0, F.array(F.lit("PHASE_1"), F.lit("PHASE_2"))).alias("phases"), F.struct(F.when(i % 4 > 0, i % 900).alias("count")).alias("enrollmentInfo")).alias("designModule"), F.struct(F.col("text").alias("briefSummary")).alias("descriptionModule"),
    ).alias("protocolSection"))
    return d.select("doc_id", F.to_json(F.struct(F.array(one).alias("studies"))).alias("body"))


def _papers(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    one = F.struct(
        F.when(i % 6 > 0, F.concat(F.lit("T "), i)).alias("title"), F.col("text").alias("abstract"), F.transform(F.sequence(F.lit(1), (i % 15 + 1).cast("int")), lambda k: F.struct(F.concat(F.lit("N "), k).alias("name"))).alias("authors"), F.when(i % 3 > 0, i % 30 + 1990).alias("year"), F.when(i % 4 > 0, F.col("source")).alias("venue"),
        F.when(i % 5 > 0, i % 70).alias("citationCount"), F.struct(F.when(i % 2 == 0, "short").alias("text")).alias("tldr"), F.struct(F.when(i % 7 > 3, F.concat(F.lit("DOI:10.1/"), i)).alias("DOI")).alias("externalIds"), F.when(i % 7 > 1, F.concat(F.lit("https://s.example/"), i)).otherwise("ftp://x").alias("url"), F.when(i % 7 > 0, F.concat(F.lit("p"), i)).alias("paperId"),
    )
    return d.select("doc_id", F.to_json(F.struct(F.array(one).alias("data"))).alias("body"))


def _articles(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    page = lambda title, extract, index: F.struct(title.alias("title"), extract.alias("extract"), index.cast("long").alias("index"))
    pages = F.array(page(F.concat(F.lit("Tom & Jerry's (é) "), i), F.col("text"), F.lit(2)), page(F.concat("source", F.lit(" it")), F.lit("an\n intro"), F.lit(1)), page(F.lit("empty"), F.lit("  "), F.lit(0)))
    return d.select("doc_id", F.to_json(F.struct(F.struct(F.when(i % 8 > 0, pages).alias("pages")).alias("query"))).alias("body"))


SUMMARY = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
STUDY_SQL = f"""SELECT doc_id, 0::INT AS place, 'https://clinicaltrials.gov/study/NCT' || doc_id AS url, title, md5(title || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Status: NOT YET RECRUITING' ELSE '' END || chr(10) || 'INTERVENTIONAL' || CASE WHEN doc_id % 5 > 0 THEN ' · PHASE 1/PHASE 2' ELSE '' END ||
  chr(10) || 'Conditions: ' || array_to_string(list_transform(range(1, least(8, doc_id % 10 + 1) + 1), lambda k: 'c' || k), ', ') || chr(10) || 'Interventions: drug x' || chr(10) || 'Sponsor: ' || source || CASE WHEN doc_id % 4 > 0 THEN chr(10) || 'Enrollment: ' || (doc_id % 900) ELSE '' END ||
  CASE WHEN s <> '' THEN chr(10) || chr(10) || s ELSE '' END) AS digest FROM (SELECT *, CASE WHEN doc_id % 3 > 0 THEN 'A title ' || doc_id ELSE 'Official ' || doc_id END AS title, {SUMMARY} AS s FROM documents) WHERE doc_id % 7 > 0"""
PAPER_SQL = f"""SELECT doc_id, 0::INT AS place, CASE WHEN doc_id % 7 > 3 THEN 'https://doi.org/10.1/' || doc_id WHEN doc_id % 7 > 1 THEN 'https://s.example/' || doc_id ELSE 'https://www.semanticscholar.org/paper/p' || doc_id END AS url, 'T ' || doc_id AS title,
  md5('T ' || doc_id || chr(10) || 'Authors: ' || array_to_string(list_transform(range(1, least(12, doc_id % 15 + 1) + 1), lambda k: 'N ' || k), ', ') || CASE WHEN doc_id % 4 > 0 THEN chr(10) || source || CASE WHEN doc_id % 3 > 0 THEN ' (' || (doc_id % 30 + 1990) || ')' ELSE '' END WHEN doc_id % 3 > 0 THEN chr(10) || '(' || (doc_id % 30 + 1990) || ')' ELSE '' END ||
  CASE WHEN doc_id % 5 > 0 THEN chr(10) || 'Cited by ' || (doc_id % 70) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'TL;DR: short' ELSE '' END || CASE WHEN s <> '' THEN chr(10) || chr(10) || s ELSE '' END) AS digest FROM (SELECT *, {SUMMARY} AS s FROM documents) WHERE doc_id % 6 > 0 AND doc_id % 7 > 0"""
ARTICLE_SQL = f"""SELECT doc_id, 0::INT AS place, 'https://en.wikipedia.org/wiki/' || source || '_it' AS url, source || ' it' AS title, md5(source || ' it' || chr(10) || chr(10) || 'an intro') AS digest FROM documents WHERE doc_id % 8 > 0
UNION ALL SELECT doc_id, 1, 'https://en.wikipedia.org/wiki/Tom_%26_Jerry''s_(%C3%A9)_' || doc_id, 'Tom & Jerry''s (é) ' || doc_id, md5('Tom & Jerry''s (é) ' || doc_id || chr(10) || chr(10) || s) FROM (SELECT *, {SUMMARY} AS s FROM documents) WHERE doc_id % 8 > 0 AND s <> ''"""
_cols = ("doc_id", "place", "url", "title")
register("sc28_studies", "documents", lambda d: study_sources(_studies(d), "doc_id", "body").select(*_cols, F.md5("text").alias("digest")), STUDY_SQL)
register("sc28_papers", "documents", lambda d: paper_sources(_papers(d), "doc_id", "body").select(*_cols, F.md5("text").alias("digest")), PAPER_SQL)
register("sc28_articles", "documents", lambda d: article_sources(_articles(d), "doc_id", "body").select(*_cols, F.md5("text").alias("digest")), ARTICLE_SQL)
register("xs35_manifest", "documents", lambda d: manifests(d.select("doc_id", F.col("source").alias("query")), article_sources(_articles(d), "doc_id", "body"), "wikipedia", "doc_id", "query"), f"""SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'wikipedia: no results for "' || source || '"' ELSE 'wikipedia: found ' || CASE WHEN {SUMMARY} <> '' THEN 2 ELSE 1 END || ' result(s) for "' || source || '"; submitted as sources:' || chr(10) || '- ' || source || ' it' || CASE WHEN {SUMMARY} <> '' THEN chr(10) || '- Tom & Jerry''s (é) ' || doc_id ELSE '' END END AS reply FROM documents""")
