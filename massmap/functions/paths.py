"""Columns over ``/``-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massmap.functions.fixed_values import EXTENSION


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """From the last dot; none for a name that only starts with one."""
    return F.regexp_extract(name, EXTENSION, 1)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(name)))


def folder_of(path: Column) -> Column:
    """The folder holding a path; the root is the empty string, and the root has none."""
    return F.when(path != "", F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1))


def folder_names(path: Column) -> Column:
    """Lower-cased folder names above a file."""
    segments = F.split(F.lower(path), "/")
    return F.filter(
        F.slice(segments, F.lit(1), F.size(segments) - 1), lambda part: (part != "") & (part != ".")
    )


def folders_above(path: Column) -> Column:
    """Every folder above a path, root first: ``a/b/c`` gives ``['', 'a', 'a/b']``."""
    segments = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda count: F.array_join(F.slice(segments, F.lit(1), count), "/"),
    )


def folder_chain(folder: Column) -> Column:
    """A folder and every folder above it, root first."""
    return F.when(folder == "", F.array(F.lit(""))).otherwise(
        F.concat(folders_above(folder), F.array(folder))
    )


def depth_of(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def relative_to(path: Column, root: Column) -> Column:
    prefix = F.concat(root, F.lit("/"))
    return (
        F.when(root == "", path)
        .when(path == root, ".")
        .when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1))
        .otherwise(path)
    )


def is_inside(path: Column, root: Column) -> Column:
    return (root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/")))
