"""Row transforms by a caller's function under a contract: request and response are checked, levels fall back, failures are rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Contract:
    """Text fields of an object: those required, those that may be left out, and whether it may hold others. A required text must hold some character unless blank is allowed."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    extra: bool = False
    blank: bool = False

    def faults(self, value: object) -> list[str]:
        """What is wrong with it, in the order of the fields; nothing if it holds."""
        if not isinstance(value, dict):
            return ["not an object"]
        out = []
        for f in (*self.required, *self.optional):
            if f not in value:
                out += [f"{f} is missing"] if f in self.required else []
            elif not isinstance(value[f], str):
                out.append(f"{f} is no text")
            elif f in self.required and not self.blank and not value[f].strip():
                out.append(f"{f} is blank")
        if not self.extra:
            out += [f"{f} is unknown" for f in sorted(set(map(str, value)) - {*self.required, *self.optional})]
        return out


def parsed(answer: object) -> object:
    """An answer as an object: a text is read as JSON, without a fence of back quotes around it."""
    if not isinstance(answer, str):
        return answer
    text = answer.strip()
    if text.startswith("```"):
        text = re.sub(r"\n?```\s*$", "", text.partition("\n")[2])
    return json.loads(text)


def transform_rows(df: DataFrame, request: dict[str, str], asked: Contract, levels: list[tuple[str, Callable[[dict], object]]], answered: Contract) -> DataFrame:
    """Each row with its response, in one pass: the columns of df, `level`, a text column for each field of the answer, `faults`.

    request names the column of each field of the request; nulls are fields that are left out, other types are cast to text. A row
    whose request breaks its contract asks nobody. Else the levels are asked in turn until one gives an answer (an object, or JSON text, in a fence or
    not) that holds its contract; an error counts as no answer. faults has an entry `level: reason` for each fault on the way; level is
    null where none was left, which makes the row a dead letter. A transform may be asked again when a task is lost, so levels must bear repetition.
    Columns of df that are named like an output are replaced.
    """
    from pyspark.sql import functions as F

    fields = (*answered.required, *answered.optional)
    made = ["level", *fields, "faults"]
    kept = df.drop(*made)
    own = kept.columns
    texts = {f: f"_request_{i}" for i, f in enumerate(request)}
    given = df.select(*own, *[F.col(c).cast("string").alias(texts[f]) for f, c in request.items()])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], "level string", *[f"`{f}` string" for f in fields], "faults array<string>"])

    def ask(asks: dict) -> tuple[str | None, dict, list[str]]:
        faults = [f"request: {x}" for x in asked.faults(asks)]
        if faults:
            return None, {}, faults
        for name, call in levels:
            try:
                answer = parsed(call(dict(asks)))
            except Exception as e:  # what a caller's function raises is a fault of its level
                faults.append(f"{name}: {type(e).__name__}")
                continue
            wrong = answered.faults(answer)
            if not wrong:
                return name, answer, faults
            faults += [f"{name}: {x}" for x in wrong]
        return None, {}, faults

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {f: b[c].to_pylist() for f, c in texts.items()}
            got = [ask({f: v[i] for f, v in columns.items() if v[i] is not None}) for i in range(b.num_rows)]
            arrays = [b[c] for c in own] + [pa.array([g[0] for g in got], pa.string())]
            arrays += [pa.array([g[1].get(f) for g in got], pa.string()) for f in fields]
            arrays.append(pa.array([g[2] for g in got], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, *made])

    return given.mapInArrow(run, schema)


def accepted(transformed: DataFrame) -> DataFrame:
    """Rows with an answer."""
    return transformed.where("level IS NOT NULL")


def dead_letters(transformed: DataFrame) -> DataFrame:
    """Rows without an answer, with their faults."""
    return transformed.where("level IS NULL")
