"""What manifests tell about a project: language, aliases, technologies, commands, ignore files."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Manifests in order of priority and the language each tells.
MANIFESTS = [
    (r"^tsconfig(\..*)?\.json$", "typescript"), (r"^Cargo\.toml$", "rust"), (r"^go\.mod$", "go"), (r"^(pyproject\.toml|setup\.py|requirements\.txt)$", "python"), (r"^Gemfile$", "ruby"),
    (r"^(pom\.xml|build\.gradle|build\.gradle\.kts)$", "java"), (r"^composer\.json$", "php"), (r"\.(csproj|sln)$", "csharp"), (r"^package\.json$", "javascript"),
]


def language(files: DataFrame) -> DataFrame:
    """One row: the language of the first manifest among the files (path) at the root, else unknown."""
    rank = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(MANIFESTS))):
        rank = F.when(F.rlike("path", F.lit(pattern)) & ~F.contains("path", F.lit("/")), i).otherwise(rank)
    names = F.array(*[F.lit(n) for _, n in MANIFESTS])
    return files.agg(F.min(rank).alias("r")).select(F.coalesce(F.get(names, "r"), F.lit("unknown")).alias("language"))


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r",(\s*[}\]])", r"\1", text)


def aliases(path: str, read: Callable[[str], str | None], extends: bool = True) -> dict[str, list[str]]:
    """Path aliases of a configuration file and those it extends; its own win, cycles end."""
    seen: set[str] = set()

    def load(p: str) -> dict[str, list[str]]:
        if p in seen or (text := read(p)) is None:
            return {}
        seen.add(p)
        try:
            conf = json.loads(strip_comments(text))
        except ValueError:
            return {}
        base: dict[str, list[str]] = {}
        if extends and isinstance(conf.get("extends"), str) and conf["extends"].startswith("."):
            parent = posixpath.normpath(posixpath.join(posixpath.dirname(p), conf["extends"]))
            base = load(parent if parent.endswith(".json") else parent + ".json")
        return base | conf.get("compilerOptions", {}).get("paths", {})

    return load(path)


def go_module(text: str) -> str:
    m = re.search(r"^module\s+(\S+)", text, re.M)
    return m[1] if m else ""


# Technologies and the dependencies that tell them; of a named group only the first counts.
TECHNOLOGIES = [
    ("framework", "Next.js", ["next"]), ("framework", "Nuxt", ["nuxt"]), ("framework", "SvelteKit", ["@sveltejs/kit"]), ("framework", "Remix", ["@remix-run/react", "@remix-run/node"]), ("framework", "Astro", ["astro"]),
    ("framework", "Gatsby", ["gatsby"]), ("framework", "Express", ["express"]), ("framework", "Fastify", ["fastify"]), ("framework", "Hono", ["hono"]), ("framework", "Koa", ["koa"]), ("framework", "NestJS", ["nestjs", "@nestjs/core"]),
    ("", "React", ["react"]), ("", "Vue", ["vue"]), ("", "Svelte", ["svelte"]), ("", "SolidJS", ["solid-js"]), ("", "Angular", ["angular", "@angular/core"]),
    ("", "React Native", ["react-native"]), ("", "Expo", ["expo"]), ("", "Capacitor", ["@capacitor/core"]), ("", "Electron", ["electron"]), ("", "Tauri", ["tauri", "@tauri-apps/api"]),
    ("orm", "Prisma ORM", ["prisma", "@prisma/client"]), ("orm", "Drizzle ORM", ["drizzle-orm"]), ("orm", "TypeORM", ["typeorm"]), ("orm", "Mongoose", ["mongoose"]), ("orm", "Sequelize", ["sequelize"]), ("orm", "Knex", ["knex"]), ("orm", "SQL client", ["pg", "mysql2", "better-sqlite3"]),
    ("", "Redis", ["redis", "ioredis"]), ("auth", "NextAuth", ["next-auth", "@auth/core"]), ("auth", "Passport.js", ["passport"]), ("auth", "Clerk", ["clerk", "@clerk/nextjs"]), ("auth", "Lucia", ["lucia", "lucia-auth"]),
    ("", "Tailwind CSS", ["tailwindcss"]), ("", "Radix UI", ["radix-ui", "@radix-ui/react-dialog", "@radix-ui/react-slot"]), ("", "shadcn/ui", ["shadcn", "shadcn-ui"]), ("", "styled-components", ["styled-components"]), ("", "Emotion", ["@emotion/react"]),
    ("", "TanStack Query", ["@tanstack/react-query"]), ("", "Zustand", ["zustand"]), ("", "Jotai", ["jotai"]), ("", "Redux", ["@reduxjs/toolkit", "redux"]), ("", "Zod validation", ["zod"]), ("", "tRPC", ["@trpc/server", "@trpc/client"]), ("", "GraphQL", ["graphql", "@apollo/client"]),
    ("", "Fumadocs", ["fumadocs-core", "fumadocs-mdx"]), ("", "MDX", ["next-mdx-remote", "@next/mdx"]), ("", "Contentlayer", ["contentlayer", "contentlayer2"]), ("", "Motion", ["motion", "framer-motion"]),
    ("", "PostHog", ["posthog-js", "@posthog/react"]), ("", "Vercel Analytics", ["@vercel/analytics"]), ("", "Sentry", ["@sentry/node", "@sentry/nextjs", "@sentry/browser"]), ("", "nuqs", ["nuqs"]),
    ("", "BullMQ", ["bullmq", "bull"]), ("", "RabbitMQ", ["amqplib"]), ("", "Kafka", ["kafkajs"]), ("", "AWS SDK", ["aws-sdk", "@aws-sdk/client-s3"]), ("", "Google Cloud", ["@google-cloud/storage"]), ("", "Firebase", ["firebase", "firebase-admin"]), ("", "Supabase", ["@supabase/supabase-js"]), ("", "Convex", ["convex"]),
    ("test", "Jest", ["jest"]), ("test", "Vitest", ["vitest"]), ("", "Playwright", ["playwright", "@playwright/test"]), ("", "Cypress", ["cypress"]), ("", "Testing Library", ["@testing-library/react"]),
    ("", "Turborepo", ["turbo", "turbo-json"]), ("", "Nx", ["nx"]), ("", "Webpack", ["webpack"]), ("", "Vite", ["vite"]), ("", "esbuild", ["esbuild"]), ("", "Rollup", ["rollup"]),
]


def technologies(dependencies: DataFrame) -> DataFrame:
    """(ord, technology) told by the dependencies (name), exclusive groups by their first."""
    rows = [(i, g or f"#{i}", n, d) for i, (g, n, ds) in enumerate(TECHNOLOGIES) for d in ds]
    table = dependencies.sparkSession.createDataFrame(rows, "ord int, grp string, technology string, name string")
    hit = dependencies.join(F.broadcast(table), "name")
    return hit.groupBy("grp").agg(F.min("ord").alias("ord"), F.min_by("technology", "ord").alias("technology")).select("ord", "technology")


# Scripts worth listing, in order.
SCRIPTS = ["dev", "build", "start", "test", "lint", "format", "typecheck", "check", "e2e", "storybook", "db:push", "db:migrate", "db:seed"]


def commands(scripts: DataFrame) -> DataFrame:
    """(ord, command, script) of the telling scripts (name, script), with the package manager."""
    text = scripts.agg(F.concat_ws(" ", F.collect_list("script")).alias("all"))
    pm = F.when(F.contains("all", F.lit("bun ")), "bun run").when(F.contains("all", F.lit("pnpm ")) | F.contains("all", F.lit("pnpm-")), "pnpm").when(F.contains("all", F.lit("yarn ")), "yarn").otherwise("npm run")
    t = scripts.where(F.col("name").isin(SCRIPTS)).crossJoin(F.broadcast(text))  # one row
    return t.select(F.array_position(F.lit(SCRIPTS), F.col("name")).cast("int").alias("ord"), F.concat(pm, F.lit(" "), "name").alias("command"), "script")


def ignore_file(lang: str, workspaces: list[str] = ()) -> str:
    """An ignore file for a language, with the folders of tests of each workspace."""
    from .parsing import DISCOVERY, IGNORED

    globs = [*IGNORED, *DISCOVERY.get(lang, DISCOVERY["typescript"])[1]]
    lines = ["# What analyses leave out", *sorted({g.removeprefix("**/").removesuffix("**") for g in globs})]
    return "\n".join([*lines, *(f"{w.rstrip('/*')}/*/tests/" if w.endswith("*") else f"{w}/tests/" for w in workspaces)]) + "\n"


def scaffold(root: str) -> list[str]:
    """The folders that commands write to below a project on this machine; those that were missing."""
    import os

    made = []
    for folder in (".loom", ".loom/diagrams", ".loom/hashes"):
        path = os.path.join(root, folder)
        if not os.path.isdir(path):
            os.makedirs(path)
            made.append(folder)
    return made


def resources(spark: SparkSession, root: str) -> dict[str, str]:
    """The texts of a project's contract, snapshot and rendered context, of those that are there."""
    from loomgraph.storage import read_text

    out = {}
    for name in ("contract", "snapshot", "context"):
        folder = f"{root.rstrip('/')}/.loom/{name}"
        if read_text(spark, f"{folder}/_SUCCESS") is not None:
            rows = spark.read.text(folder).select("value").collect()  # files that people read
            out[name] = "\n".join(r[0] for r in rows)
    return out
