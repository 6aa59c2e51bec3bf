"""Rules of what is allowed: merging them, and asking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one source; null means that it says nothing.
RULES = "scope string, place int, source string, edits boolean, shell boolean, shell_allowed array<string>, shell_ms long, sandbox boolean, web boolean, providers array<string>, local_only boolean, ignore array<string>, audit boolean"
# Providers that send nothing away.
LOCAL = ("ollama", "local")


def merged(rules: DataFrame) -> DataFrame:
    """One row for each scope: the most restrictive of all its sources' RULES.

    Allowed only where no source forbids; lists of what is allowed are intersected and those of what is ignored united; demands stay, the least time counts.
    """
    order = F.array_sort(F.collect_list(F.struct("place", "source", "shell_allowed", "providers", "ignore")))
    folded = rules.groupBy("scope").agg(
        *(F.bool_and(c).alias(c) for c in ("edits", "shell", "web")), *(F.bool_or(c).alias(c) for c in ("sandbox", "local_only", "audit")), F.min("shell_ms").alias("shell_ms"), order.alias("parts")
    )
    none = F.lit(None).cast("array<string>")
    meet = lambda c: F.aggregate("parts", none, lambda s, p: F.when(s.isNull(), p[c]).when(p[c].isNull(), s).otherwise(F.array_intersect(s, p[c])))
    join = lambda c: F.array_distinct(F.flatten(F.transform("parts", lambda p: F.coalesce(p[c], F.array().cast("array<string>")))))
    return folded.select("scope", "edits", "shell", meet("shell_allowed").alias("shell_allowed"), "shell_ms", "sandbox", "web", meet("providers").alias("providers"), "local_only", join("ignore").alias("ignore"), "audit", F.transform("parts", lambda p: p["source"]).alias("sources"))


def allowed(flag: Column) -> Column:
    """Whatever is not forbidden is allowed."""
    return F.coalesce(flag, F.lit(True))


def shell_commands(allowed: Column, requested: Column) -> Column:
    """The commands that may run: those requested and allowed; all that are allowed where none are requested."""
    return F.when(allowed.isNull(), requested).when(F.size(requested) == 0, allowed).otherwise(F.array_intersect(requested, allowed))


def provider_problem(provider: Column, local_only: Column, providers: Column) -> Column:
    """Why an embedding provider may not be used, or null."""
    return F.when(F.coalesce(local_only, F.lit(False)) & ~provider.isin(*LOCAL), "local only").when(providers.isNotNull() & ~F.array_contains(providers, provider), "not allowed")


def described(rules: DataFrame) -> Column:
    """One line that tells what merged rules restrict."""
    told = lambda condition, text: F.when(condition, text)
    listed = lambda c: F.array_join(c, ", ")
    parts = F.concat_ws(
        "; ", told(~allowed(F.col("edits")), F.lit("edits: blocked")),
        F.when(~allowed(F.col("shell")), "shell: blocked").when(F.col("shell_allowed").isNotNull(), F.concat(F.lit("shell allowlist: ["), listed("shell_allowed"), F.lit("]"))),
        told(~allowed(F.col("web")), F.lit("web-search: blocked")),
        F.when(F.col("local_only"), "embeddings: local-only").when(F.col("providers").isNotNull(), F.concat(F.lit("embedding providers: ["), listed("providers"), F.lit("]"))),
        told(F.size("ignore") > 0, F.concat(F.size("ignore").cast("string"), F.lit(" pinned ignore pattern(s)"))), told(F.col("audit"), F.lit("audit: required")),
    )
    return F.when(parts == "", "no restrictions").otherwise(parts)
