"""Project-path expressions: parents, top folders and part clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
MODE_FOLDERS = ("individual", "unificado")
ROOT_FOLDER = "projects"


def path_parts(path: Column) -> Column:
    """Non-empty parts of a path written with either slash."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")


def parent_path(path: Column, modes: Sequence[str] = MODE_FOLDERS) -> Column:
    """The path without its last part when that part is a mode folder.

    A trailing slash makes the last part empty, so nothing is dropped then.
    """
    raw = F.split(F.translate(path, "\\", "/"), "/")
    kept = F.when(F.element_at(raw, -1).isin(*modes), F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    return F.array_join(F.filter(kept, lambda p: p != ""), "/")


def project_folder(path: Column, root: str = ROOT_FOLDER) -> Column:
    """First part below the root folder, else the first part, else ``unknown``."""
    parts = path_parts(path)
    below = F.when((F.get(parts, F.lit(0)) == root) & (F.size(parts) > 1), F.get(parts, F.lit(1)))
    return F.coalesce(below, F.get(parts, F.lit(0)), F.lit("unknown"))


def output_folder(path: Column, root: str = ROOT_FOLDER) -> Column:
    """Relative folder for a project's results: its parts without the root."""
    return F.array_join(F.filter(path_parts(path), lambda p: p != root), "/")
