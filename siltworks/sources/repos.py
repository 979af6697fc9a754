"""Tables of repositories, files and people, made of what was collected elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import constants as K
from siltworks.functions import paths
from siltworks.operators import units

MOST_RESULTS, MOST_PATHS, LARGEST_FILE, MOST_COMMITS, MOST_PATCHES = 1000, 800, 200_000, 15, 30


def search_page(hits: DataFrame, page: int, per_page: int, order: str = "hit_ord") -> DataFrame:
    """A page of each query's hits, none beyond the host's cap."""
    turn = F.row_number().over(Window.partitionBy("query").orderBy(order))
    stop = min(MOST_RESULTS, page * per_page)
    return hits.withColumn("turn", turn).where((F.col("turn") > (page - 1) * per_page) & (F.col("turn") <= stop))


def repositories_of(code_hits: DataFrame) -> DataFrame:
    """Code hits to one row a repository, the first with its path; rows without id, name or owner go."""
    rows = code_hits.dropna(subset=["repo_id", "full_name", "owner"])
    return rows.groupBy("repo_id").agg(F.min(F.struct("hit_ord", "full_name", "owner", "path")).alias("f")).select(
        "repo_id", "f.full_name", "f.owner", F.col("f.path").alias("matched_path")
    )


def listed(files: DataFrame, root_only: bool = False) -> DataFrame:
    """The first paths of each tree, or those of its root."""
    rows = files.where(~F.contains("path", F.lit("/"))) if root_only else files
    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy("ord"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= MOST_PATHS)


def read_tree(spark: SparkSession, path: str, largest: int = LARGEST_FILE) -> DataFrame:
    """Files of a checked-out tree as (repo_id, ord, path, content, size), paths from its root on.

    Text of bounded size outside folders that scans leave out: binary files go by their first
    bytes, before anything is decoded; bytes that are no UTF-8 become replacement characters.
    Empty files have nothing to scan and are left out. Spark's readers pass over names that
    begin with a dot or an underscore; of a tree, which is one checkout, the driver reads those.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = raw.select("path", F.col("length").alias("size"), "content").where(F.col("size") <= largest)
    root = re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", path).rstrip("/") + "/"
    rows = raw.unionByName(_hidden(spark, path, largest))
    start = F.position(F.lit(root), F.col("path")) + len(root)
    rows = rows.withColumn("path", F.substr("path", start, F.length("path") - start + 1))
    head = F.substring("content", 1, 512).cast("string")
    rows = rows.where(~paths.is_excluded(F.col("path")) & (F.position(F.lit("\0"), head) == 0))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    key = F.lit(root.rsplit("/", 2)[1]).alias("repo_id"), F.xxhash64("path").alias("ord")
    return rows.select(*key, "path", text.alias("content"), "size")


def _hidden(spark: SparkSession, path: str, largest: int) -> DataFrame:
    """Rows (path, size, content) of a tree's files whose name, or a folder's of them, begins with a dot or underscore."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, waiting = [], [(root, False)]
    while waiting:
        folder, within = waiting.pop()
        for status in fs.listStatus(folder):
            name, size = status.getPath().getName(), status.getLen()
            hidden = within or name.startswith((".", "_"))
            if status.isDirectory():
                if name not in K.EXCLUDED_DIRS:
                    waiting.append((status.getPath(), hidden))
            elif hidden and 0 < size <= largest:
                stream = fs.open(status.getPath())
                found.append((status.getPath().toString(), size, bytearray(stream.readAllBytes())))
                stream.close()
    return spark.createDataFrame(found, "path string, size long, content binary")


def scanned(files: DataFrame, aliases: DataFrame, keywords: DataFrame, sample: int = MOST_PATHS) -> dict[
    str,
    DataFrame,
]:
    """What a scan takes from trees' files(repo_id, ord, path, content): the README, a ranked sample, and three greps.

    aliases and keywords are tables (term, ord). The greps go over all files, the sample is
    what rules read.
    """
    texts = files.select("repo_id", "path", "content")
    return {
        "readme": readme(files),
        "sample": paths.sampled(files, sample),
        "brand_hits": units.grep(texts, aliases),
        "keyword_hits": units.grep(texts, keywords, boundary=False),
        "secret_lines": units.secret_candidates(texts),
    }


def readable(files: DataFrame, largest: int = LARGEST_FILE) -> DataFrame:
    """files(path, content) that are text of bounded size and in no folder that scans leave out."""
    size = F.octet_length("content")
    return files.where(~paths.is_excluded(F.col("path")) & ~paths.is_binary_or_large(F.col("content"), size, largest))


def readme(files: DataFrame) -> DataFrame:
    """The first file of each tree that is a README."""
    return files.where(paths.is_readme(F.col("path"))).groupBy("repo_id").agg(
        F.min_by("path", "ord").alias("readme_path")
    )


def added_lines(patch: Column) -> Column:
    """The lines that a patch adds, without their marks."""
    mine = F.filter(F.split(patch, "\n", -1), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(mine, lambda x: F.substr(x, F.lit(2))), "\n")


def history_files(patches: DataFrame) -> DataFrame:
    """patches(repo_id, commit_ord, sha, path, patch) as files named history/<sha>/<path>, of the last commits."""
    by_repo = Window.partitionBy("repo_id").orderBy("commit_ord")
    rows = patches.withColumn("_c", F.dense_rank().over(by_repo)).where(F.col("_c") <= MOST_COMMITS)
    rows = rows.withColumn("content", added_lines(F.col("patch"))).where(F.length("content") > 0)
    rows = rows.withColumn(
        "turn", F.row_number().over(Window.partitionBy("repo_id").orderBy("commit_ord", "path"))
    ).where(F.col("turn") <= MOST_PATCHES)
    return rows.select(
        "repo_id",
        F.concat(F.lit("history/"), F.substring("sha", 1, 7), F.lit("/"), "path").alias("path"),
        "content",
        "turn",
    )


def people(contributors: DataFrame) -> DataFrame:
    """Contributors with a login who are no bots; missing counts are 0."""
    rows = contributors.where("login is not null and coalesce(type, '') <> 'Bot'")
    return rows.withColumn("contributions", F.coalesce("contributions", F.lit(0)))


def deployment(deployments: DataFrame, repos: DataFrame) -> DataFrame:
    """The latest deployment of each repository; its homepage, if there is one, is the address."""
    last = deployments.groupBy("repo_id").agg(F.max_by(F.struct("environment", "url", "state"), "at").alias("d"))
    return last.join(repos.select("repo_id", "homepage"), "repo_id").select(
        "repo_id", "d.environment", "d.state", F.coalesce(F.when(F.length("homepage") > 0, F.col("homepage")), "d.url").alias("url")
    )


def remote_head(listing: Column) -> Column:
    """Struct (sha, default_branch) of a remote's listing."""
    return F.struct(
        F.regexp_extract(listing, r"(?m)^([0-9a-f]{40})\s+HEAD$", 1).alias("sha"), F.regexp_extract(listing, r"(?m)^ref: refs/heads/(\S+)\s+HEAD$", 1).alias("default_branch")
    )


def own_work(repos: DataFrame) -> DataFrame:
    """An owner's repositories that are no forks."""
    return repos.where(~F.coalesce("is_fork", F.lit(False)))
