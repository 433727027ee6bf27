"""Fixed values of the data model and the expressions built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of a split.
SPLITS = {
    "train": "train",
    "training": "train",
    "val": "val",
    "valid": "val",
    "validation": "val",
    "dev": "val",
    "test": "test",
    "testing": "test",
}

# The file extensions of images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp")


def trimmed(c: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.btrim(c, F.lit(" \t"))


def split_of(c: Column) -> Column:
    """train, val or test; null for everything else."""
    key = F.lower(trimmed(c))
    out = F
    for name in ("train", "val", "test"):
        out = out.when(key.isin([k for k, v in SPLITS.items() if v == name]), name)
    return out


def group_of(c: Column) -> Column:
    """A group key, trimmed and in lower case; null if it is empty or the text ``nan``."""
    key = F.lower(trimmed(c))
    return F.when((key != "") & (key != "nan"), key)
