"""Schemas, models, routes and settings of a project: found by path, typed, ordered and read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S

from .parsing import matches, spread

# Where such files lie, where they are not looked for, how large one may be, and in
# which order their types come.
PATTERNS = """**/prisma/schema.prisma **/drizzle/**/*.ts **/schema/**/*.{ts,js,graphql,gql,sql} **/models/**/*.{ts,js} **/*.schema.{ts,js} **/*.model.{ts,js}
**/models.py **/schemas.py **/serializers.py **/models/**/*.py **/app/models/**/*.rb **/db/schema.rb **/models/*.go **/*_model.go **/schema.rs **/models.rs
**/entity/**/*.java **/model/**/*.java **/dto/**/*.java **/Entities/**/*.php **/Models/**/*.php **/*.graphql **/*.gql **/*.proto
**/openapi.{yaml,yml,json} **/swagger.{yaml,yml,json} **/routes/**/*.{ts,js} **/router.{ts,js}
**/migrations/**/migration.sql **/db/migrate/**/*.rb **/alembic/**/*.py **/migrations/**/*.sql **/types/**/*.{ts,js} **/types.{ts,js} **/interfaces/**/*.{ts,js}
**/docker-compose.{yml,yaml} **/Dockerfile .env.example .env.local.example **/schema.{yaml,yml,json} **/*.avsc **/*.thrift""".split()
SKIPPED = """**/node_modules/** **/dist/** **/.next/** **/.nuxt/** **/.svelte-kit/** **/.astro/** **/*.d.ts **/*.test.{ts,js,tsx,jsx} **/*.spec.{ts,js,tsx,jsx} **/build/** **/coverage/** **/.git/**
**/__pycache__/** **/*.pyc **/venv/** **/.venv/** **/.tox/** **/vendor/** **/target/** **/bin/** **/obj/** **/deps/** **/_build/** **/.gradle/**""".split()
LARGEST = 50_000
ORDER = ["schema", "model", "types", "api-spec", "routes", "migration", "docker", "config"]


def braces(glob: str) -> list[str]:
    """The globs that a glob with {a,b} stands for."""
    m = re.search(r"\{([^{}]*)\}", glob)
    return [g for x in m[1].split(",") for g in braces(glob[: m.start()] + x + glob[m.end() :])] if m else [glob]


def priority(kind: Column) -> Column:
    return F.array_position(F.lit(ORDER), kind).cast("int")


def discover(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """(path, type, size, priority, text) of context files among files (path, text).

    Empty files and those above LARGEST bytes are left out, and migrations where a schema exists,
    as they tell of the past.  Files are distinct paths; order by priority, then path.
    """
    wanted, skipped = ([g for p in patterns for g in braces(p)] for patterns in (PATTERNS, [*SKIPPED, *ignore]))
    size, kind = F.octet_length("text").cast("long"), S.context_kind(F.col("path"))
    # large texts go first; paths are judged and told apart by as many tasks as there are cores for: the partition's
    # number keeps the optimizer from judging them where they are read
    dealt = F.spark_partition_id() >= 0
    listed = matches(F.col("path"), wanted) & ~matches(F.col("path"), skipped)
    fit = files.select("path", "text", size.alias("size")).where(F.col("size").between(1, LARGEST))
    found = spread(fit).where(F.when(dealt, listed)).dropDuplicates(["path"]).select("path", kind.alias("type"), "size", "text")
    schema = spread(fit.select("path")).where(F.when(dealt, (kind == "schema") & listed)).agg((F.count("*") > 0).alias("has_schema"))
    kept = found.crossJoin(F.broadcast(schema)).where("NOT (has_schema AND type = 'migration')")  # one row
    return kept.select("path", "type", "size", priority(F.col("type")).alias("priority"), "text")
