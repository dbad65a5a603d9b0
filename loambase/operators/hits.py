"""Search hits: what kind of note they are, filters, results for clients; search over several layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import frontmatter, is_verified, kebab, preview, round4
from .search import best_candidates, diversified

#: Folders and the category of their notes; categories of clients; types with a category of their own.
FOLDERS = {"patterns": "pattern", "gotchas": "gotcha", "decisions": "decision", "tools": "tool", "articles": "article", "topics": "topic", "pdfs": "pdf"}
SESSION_FOLDERS = ["patterns", "gotchas", "decisions", "tools"]
TYPES = ["article", "topic", "pdf"]


def _folder(path: Column, folders: list[str]) -> Column:
    names = F.create_map(*(F.lit(x) for k in folders for x in (k, FOLDERS[k])))
    return F.try_element_at(names, F.split(path, "/")[0])


def wire_category(front: Column, path: Column, topics: str = "topics") -> Column:
    """A hit's category for clients: its type, or else a valid category, or else that of its folder, or else
    pattern. ``topics``: the name of the folder of topic pages."""
    folder = F.when(F.split(path, "/")[0] == topics, "topics/").otherwise(path)
    kind, category = F.try_element_at(front, F.lit("type")), F.try_element_at(front, F.lit("category"))
    return F.when(kind.isin(TYPES), kind).when(category.isin(sorted(FOLDERS.values())), category).otherwise(F.coalesce(_folder(folder, list(FOLDERS)), F.lit("pattern")))


def metadata(front: Column, title: Column) -> Column:
    """Struct of topic, category, project, type, url of a hit."""
    get = lambda k: F.try_element_at(front, F.lit(k))
    kind, base = get("type"), F.element_at(F.split(title, "/"), -1)
    topic = F.when(kind.isin("article", "pdf"), get("source_title")).when(kind == "topic", get("title")).otherwise(get("topic"))
    category = F.when(kind == "topic", "topic").when(kind.isin("article", "pdf"), get("category")).otherwise(F.coalesce(get("category"), _folder(title, SESSION_FOLDERS)))
    project = F.when(kind == "article", get("source_author")).when(kind.isin("pdf", "topic"), F.lit("")).otherwise(get("project"))
    return F.struct(
        F.coalesce(topic, base).alias("topic"), F.coalesce(category, F.lit("")).alias("category"), F.coalesce(project, F.lit("")).alias("project"),
        F.when(kind.isin(TYPES), kind).otherwise("session").alias("type"), F.when(kind == "article", get("source_url")).alias("url"),
    )


def fetch_size(k: int, filtered: bool) -> int:
    """How many hits a search gives before the filters."""
    return min(30, 5 * k) if filtered else k


def filtered(hits: DataFrame, k: int = 5, kind: str = "all", category: str | None = None, project: str | None = None, verified: bool = False) -> DataFrame:
    """Hits (query, rank, title, content, score), of a search for ``fetch_size`` hits, that pass the filters: the
    first k of each query (1 to 10), ranked anew."""
    k = min(max(k, 1), 10)
    rows = hits.filter(F.col("rank") <= fetch_size(k, bool(category or project or verified or kind != "all")))
    rows = rows.withColumn("meta", metadata(frontmatter(F.col("content")), F.col("title")))
    for test in (
        F.col("meta.type") == kind if kind != "all" else None,
        F.col("meta.category") == category if category else None,
        kebab(F.col("meta.project")) == kebab(F.lit(project)) if project else None,
        is_verified(F.col("content")) if verified else None,
    ):
        rows = rows if test is None else rows.filter(test)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def results(hits: DataFrame, topics: str = "topics") -> DataFrame:
    """Hits (query, rank, path, content, score) as clients get them: path, score, category, confidence (0 if it
    is no finite number), preview, project (null if empty), date."""
    front = frontmatter(F.col("content"))
    get = lambda k: F.try_element_at("__front", F.lit(k))
    sure = F.trim(get("confidence")).try_cast("double")
    return hits.withColumn("__front", front).select(
        "query", "rank", "path", "score", wire_category(F.col("__front"), F.col("path"), topics).alias("category"),
        F.when(sure.isNotNull() & ~F.isnan(sure) & (F.abs(sure) < float("inf")), sure).otherwise(0.0).alias("confidence"),
        preview(F.col("content")).alias("preview"), F.nullif(get("project"), F.lit("")).alias("project"), F.coalesce(get("date"), F.lit("")).alias("date"),
    )


def _pool(layers: dict[str, DataFrame], boost: float) -> DataFrame:
    """(layer, doc, vector, bonus) of all layers (doc, vector, content, verified). Rows without content are no candidates; verified
    ones get ``boost`` on top, before anything is ranked."""
    parts = []
    for layer, rows in layers.items():
        rows = rows.filter(F.coalesce(F.trim("content"), F.lit("")) != "")
        parts.append(rows.select(F.lit(layer).alias("layer"), "doc", "vector", F.when(F.coalesce("verified", F.lit(False)), boost).otherwise(0.0).alias("bonus")))
    return reduce(DataFrame.unionByName, parts)


def layered(layers: dict[str, DataFrame], queries: DataFrame, k: int = 8, floor: float = 0.3, boost: float = 0.2) -> DataFrame:
    """(query, layer, doc, score) of all layers at cosine ``floor`` or more that may be among a query's k best."""
    return best_candidates(_pool(layers, boost), queries, k, floor)


def diverse(layers: dict[str, DataFrame], queries: DataFrame, k: int = 8, floor: float = 0.3, boost: float = 0.2, relevance: float = 0.7) -> DataFrame:
    """(query, layer, doc, score, rank): the search over all layers, re-ranked for diversity."""
    return diversified(_pool(layers, boost), queries, k, floor, relevance)


def best(candidates: DataFrame, k: int = 8) -> DataFrame:
    """The k best candidates of each query, over all layers."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "layer", "doc"))
    return candidates.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query", "layer", "doc", round4(F.col("score")).alias("score"), "rank")
