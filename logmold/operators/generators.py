"""Template generators (P1, P2): one template per cache key that missed.

A generator sees only the first batch of every missing key (the reference
parses a key once and serves later batches from the cache), so the model
runs on distinct batches, never on every line.

* ``FallbackGenerator`` (default): what the reference produces when no model
  can be loaded -- the masked first line of the batch, normalised, empty raw
  output. Pure Column expressions, no Python worker.
* ``ModelGenerator``: a user-supplied ``prompt -> raw output`` callable run by
  ``mapInPandas`` over Arrow batches; output extraction and normalisation
  stay JVM-side. Any exception on a batch falls back to the heuristic.
* ``CallableGenerator``: a user ``lines -> template`` callable (the plain
  parser contract: raw output echoes the template), such as ``common_words``.
"""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.functions.text import (
    PLACEHOLDER,
    build_prompt,
    extract_template,
    heuristic_template,
    normalize_template,
)
from logmold.session import ship_package

GENERATED_SCHEMA = "cache_key STRING, template STRING, raw_output STRING, used_fallback BOOLEAN"

# One loaded model per Python worker process and generator (keyed by a token
# fixed on the driver, so every task of the job finds the same entry).
_MODELS: dict[str, Callable] = {}


def _model(key: str, factory: Callable[[], Callable]) -> Callable:
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def fallback_template(first_text) -> Column:
    """F6 then F7 on the first line of a batch."""
    return normalize_template(heuristic_template(first_text))


class TemplateGenerator:
    """Contract. ``misses`` has cache_key, first_text and, when
    ``needs_lines``, texts (array<string>, batch order)."""

    needs_lines = False
    # True when a recompute could give another answer (a model): the
    # generated table is then checkpointed before it is used twice.
    nondeterministic = False

    def columns(self, first_text: Column) -> tuple[Column, Column, Column] | None:
        """(template, raw_output, used_fallback) as Columns, or None when the
        generator needs ``generate``."""
        return None

    def generate(self, misses: DataFrame) -> DataFrame:
        raise NotImplementedError


class FallbackGenerator(TemplateGenerator):
    def columns(self, first_text):
        return fallback_template(first_text), F.lit(""), F.lit(True)

    def generate(self, misses: DataFrame) -> DataFrame:
        t, raw, fb = self.columns(F.col("first_text"))
        return misses.select("cache_key", t.alias("template"), raw.alias("raw_output"), fb.alias("used_fallback"))


class ModelGenerator(TemplateGenerator):
    """``factory()`` returns ``generate(prompt: str) -> str``; called once per worker."""

    needs_lines = True
    nondeterministic = True

    def __init__(self, factory: Callable[[], Callable[[str], str]]):
        import uuid

        self.factory = factory
        self.key = uuid.uuid4().hex

    def generate(self, misses: DataFrame) -> DataFrame:
        ship_package(misses.sparkSession)
        factory, key = self.factory, self.key

        def run(frames: Iterator):
            import pandas as pd

            model = None
            load_error = False
            for pdf in frames:
                if model is None and not load_error:
                    try:
                        model = _model(key, factory)
                    except Exception:
                        load_error = True
                raws, failed = [], []
                for prompt in pdf["prompt"]:
                    try:
                        if load_error:
                            raise RuntimeError("model unavailable")
                        raws.append(str(model(prompt)))
                        failed.append(False)
                    except Exception:
                        raws.append("")
                        failed.append(True)
                yield pd.DataFrame({
                    "cache_key": pdf["cache_key"], "first_text": pdf["first_text"],
                    "raw_output": raws, "used_fallback": failed,
                })

        prompts = misses.select("cache_key", "first_text", build_prompt(F.col("texts")).alias("prompt"))
        raw = prompts.mapInPandas(
            run, "cache_key STRING, first_text STRING, raw_output STRING, used_fallback BOOLEAN"
        )
        template = F.when(F.col("used_fallback"), fallback_template(F.col("first_text"))).otherwise(
            normalize_template(extract_template(F.col("raw_output")))
        )
        return raw.select("cache_key", template.alias("template"), "raw_output", "used_fallback")


class CallableGenerator(TemplateGenerator):
    """``parse(lines: list[str]) -> str`` per missed batch (Arrow batches)."""

    needs_lines = True

    def __init__(self, parse: Callable[[list], str], deterministic: bool = True):
        self.parse = parse
        self.nondeterministic = not deterministic

    def generate(self, misses: DataFrame) -> DataFrame:
        ship_package(misses.sparkSession)
        parse = self.parse

        def run(frames: Iterator):
            import pandas as pd

            for pdf in frames:
                out = [str(parse(list(lines))) for lines in pdf["texts"]]
                yield pd.DataFrame({
                    "cache_key": pdf["cache_key"], "template": out, "raw_output": out,
                    "used_fallback": [False] * len(out),
                })

        return misses.select("cache_key", "texts").mapInPandas(run, GENERATED_SCHEMA)


def common_words(lines: list) -> str:
    """A template from all lines of a batch: at each place the word that all of
    them have there, else the placeholder; as many places as the shortest line has."""
    places = zip(*(line.split() for line in lines))
    return " ".join(words[0] if len(set(words)) == 1 else PLACEHOLDER for words in places)
