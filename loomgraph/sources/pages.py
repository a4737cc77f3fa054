"""Links among pages of documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(source, target): distinct paths that pages refer to; null texts refer to none."""
    found = F.explode(F.regexp_extract_all(html_col, F.lit('href="(/[^"]*)"'), 1))
    return pages.select(F.col(id_col).alias("source"), found.alias("target")).distinct()


def link_graph(pages: DataFrame, known: DataFrame, id_col: str = "page_id", html_col: str = "html", path_col: str | None = None) -> DataFrame:
    """Links whose target is a known page (path); with ``path_col`` those of a page to itself are
    dropped."""
    out = links(pages, id_col, html_col).join(known.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select("source", "target")
    if path_col is None:
        return out
    own = pages.select(F.col(id_col).alias("source"), F.col(path_col).alias("target"))
    return out.join(own, ["source", "target"], "left_anti")
