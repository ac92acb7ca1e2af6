"""The hook for user-supplied recognisers of images."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.operators.recognition import parse_command_output


class Recogniser(Protocol):
    """Reads one PNG; gives text or JSON of text, confidence and model."""

    name: str

    def __call__(self, png: bytes, language: str) -> str: ...


def command(argv: list[str], timeout: float = 60.0) -> Callable[[bytes, str], str]:
    """A recogniser that runs ``argv image language``."""

    def run(png: bytes, language: str) -> str:
        with tempfile.NamedTemporaryFile(suffix=".png") as f:
            f.write(png)
            f.flush()
            return subprocess.run([*argv, f.name, language], capture_output=True, text=True, timeout=timeout, check=True).stdout

    return run


def recognise(images: DataFrame, reader: Callable[[bytes, str], str], language: str = "eng", engine: str = "external") -> DataFrame:
    """Each different image is read once, and its result goes to all images with its hash.

    ``images`` has ``sha1, png`` and more.  A reader that fails leaves an empty text and a
    warning, and the others go on.  Adds ``text, confidence, model, engine, warnings``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, why = [], []
            for image in pdf["png"]:
                try:
                    out.append(reader(bytes(image), language))
                    why.append(None)
                except Exception as e:
                    out.append("")
                    why.append(f"{engine}-failed: {type(e).__name__}")
            yield pd.DataFrame({"sha1": pdf["sha1"], "said": out, "why": why})

    once = images.where("png is not null").groupBy("sha1").agg(F.first("png").alias("png"))
    read = once.mapInPandas(run, "sha1 string, said string, why string")
    read = read.select("sha1", parse_command_output(F.col("said")).alias("r"), F.array_compact(F.array("why")).alias("warnings"))
    return images.join(read.select("sha1", "r.*", F.lit(engine).alias("engine"), "warnings"), "sha1", "left")


ENGINES: dict[str, Callable] = {}


def register(name: str, reader: Callable[[bytes, str], str]) -> None:
    """Make a recogniser known by name."""
    ENGINES[name] = reader


def resolve(name: str | None = None) -> Callable[[bytes, str], str]:
    """The recogniser of a name, or the only one there is."""
    if name is None and len(ENGINES) == 1:
        return next(iter(ENGINES.values()))
    if name not in ENGINES:
        raise ValueError(f"unknown recogniser {name!r}; known: {sorted(ENGINES)}")
    return ENGINES[name]
