"""Ignore files: ordered patterns as one column over paths, folders that hold nothing else, and pages to leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mirrors import nearest_ancestor

# Names that stand for all that a folder may hold.
PROBES = ("a", "a.txt", "a.md", ".hidden", "no-extension-file", "sub/a.bin", "sub/deep/file.dat", "x/y/z")
OWN = ".mddignore"


def _segment(glob: str) -> str:
    """Regular expression of one path segment's glob."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "\\" and i < len(glob):
            out, i = out + re.escape(glob[i]), i + 1
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] in ("!", "^")))) > 0:
            inside = glob[i:end]
            negated = inside[:1] in ("!", "^")
            out += "[" + ("^" if negated else "") + inside[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(ignores, regular expression) of each pattern line; group 1 is the slash below a folder that the pattern names.

    A pattern with a slash before its end begins at the root, others in any folder; one that ends in a slash names
    folders only; ``**`` stands for any folders. ``!`` takes back, ``#`` is a comment, ``\\`` escapes either.
    """
    out = []
    for line in lines:
        text = line if line.endswith("\\ ") else line.rstrip()
        if not text or text.startswith("#") or text in ("/", "!"):
            continue
        ignores = not text.startswith("!")
        text = text[0 if ignores else 1 :]
        text = text[1:] if re.match(r"\\[#!]", text) else text
        folder, rooted = text.endswith("/"), "/" in text.rstrip("/")
        parts = [p for k, p in enumerate(text.strip("/").split("/")) if p != "**" or k == 0 or text.strip("/").split("/")[k - 1] != "**"]
        parts = parts if rooted or parts[0] == "**" else ["**", *parts]
        if parts in (["**"], ["**", "**"]):
            out.append((ignores, "^[^/]+(?:(/).*)?$" if not folder else "^.*?[^/]+(/).*$"))
            continue
        tail = "(/).*" if folder else "(?:(/).*)?"
        regex = ""
        for k, part in enumerate(parts):
            if part == "**":
                regex += "(?:.+/)?" if k == 0 else "()/.*" if k == len(parts) - 1 else "(?:/.+)?"
            else:
                regex += ("/" if k and not (k == 1 and parts[0] == "**") else "") + ("[^/]+" if part == "*" else _segment(part))
        out.append((ignores, f"^{regex}{'' if parts[-1] == '**' and len(parts) > 1 else tail}$"))
    return out


def is_ignored(path: Column, lines: list[str], is_dir: bool = False) -> Column:
    """Whether a path from the root is ignored: the last pattern that matches decides.

    A pattern that matches a folder above gives way to one that matches the path itself, but when it ignores and
    comes later. A null path isn't ignored.
    """
    path = F.when(F.lit(is_dir) & ~path.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path)
    compiled = rules(lines)
    if not compiled:
        return F.lit(False)
    hits = F.array(*[F.when(path.rlike(r), F.struct(F.lit(i).alias("ignores"), (F.regexp_extract(path, r, 1) == "/").alias("above"))) for i, r in compiled])
    shape = "struct<ignores:boolean,rank:int>"

    def step(have: Column, hit: Column) -> Column:
        rank = F.when(hit["above"], 1).otherwise(2)
        wins = (hit["ignores"] & hit["above"]) | (rank >= have["rank"])
        return F.when(wins, F.struct(hit["ignores"].alias("ignores"), rank.alias("rank")).cast(shape)).otherwise(have)

    zero = F.struct(F.lit(False).alias("ignores"), F.lit(0).alias("rank")).cast(shape)
    return F.coalesce(F.aggregate(F.filter(hits, lambda h: h.isNotNull()), zero, step, lambda have: have["ignores"]), F.lit(False))


def prunes(folder: Column, lines: list[str]) -> Column:
    """Whether all that a folder may hold is ignored: the folder itself, or each of some unlike names in it."""
    inside = [is_ignored(F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit(p)), lines) for p in PROBES]
    every = inside[0]
    for test in inside[1:]:
        every = every & test
    return is_ignored(folder, lines, is_dir=True) | every


def prunable(files: DataFrame, lines: list[str], path: str = "path") -> DataFrame:
    """Ignored files of a mirror that a clean-up may delete: not the ignore file, nor names or folders with a dot at the root."""
    return files.where(is_ignored(F.col(path), lines) & ~F.col(path).startswith(".") & (F.col(path) != OWN))


def page_verdicts(pages: DataFrame, lines: list[str]) -> DataFrame:
    """Add verdict and skip_path to pages (md_rel, their file, and child_rel, the folder of the pages below them).

    In this order: prune-root if all in the folder is ignored (skip_path: the folder with a slash), prune-descendant
    below such a folder, file-skip if the file is ignored (skip_path: the file), else keep.
    """
    marked = pages.withColumn("_root", prunes(F.col("child_rel"), lines))
    folders = marked.where("_root").select(F.col("child_rel").alias("path"))
    above = nearest_ancestor(marked.select("md_rel").distinct().withColumnRenamed("md_rel", "path"), folders)
    joined = marked.join(above.withColumnRenamed("path", "md_rel"), "md_rel", "left")
    file = is_ignored(F.col("md_rel"), lines)
    verdict = F.when(F.col("_root"), "prune-root").when(F.col("ancestor").isNotNull(), "prune-descendant").when(file, "file-skip").otherwise("keep")
    skip = F.when(F.col("_root"), F.concat("child_rel", F.lit("/"))).when(F.col("ancestor").isNotNull(), None).when(file, F.col("md_rel"))
    return joined.withColumns({"verdict": verdict, "skip_path": skip}).drop("_root", "ancestor")


def filter_desired(pages: DataFrame, tracked: DataFrame, lines: list[str], key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """The pages that stay, and the distinct paths that are left out. Tracked pages and those without a path always stay."""
    known = tracked.select(key).distinct().withColumn("_tracked", F.lit(True))
    judged = page_verdicts(pages, lines).join(known, key, "left")
    stays = F.coalesce(F.col("_tracked"), F.lit(False)) | F.col("md_rel").isNull() | (F.col("verdict") == "keep")
    skipped = judged.where(~stays & F.col("skip_path").isNotNull()).select("skip_path").distinct()
    return judged.where(stays).select(pages.columns), skipped
