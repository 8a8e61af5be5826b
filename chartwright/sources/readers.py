"""Sources: grammar documents, normal-form files, n-gram texts, weighted automata, embedded resources, weights, machine states."""

from __future__ import annotations

import base64
import gzip
import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.functions.grammar import START, Grammar, load, load_normal
from chartwright.functions.text import tokenise
from chartwright.operators.scoring import Automaton

_CACHE: dict[tuple, tuple[Grammar, str]] = {}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, grammar, sentence, line, tokens): the sentences of each grammar document, a glob allowed; a path may not climb."""
    if ".." in path.split("/"):
        raise ValueError("a path may not contain ..")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split("value", r"(?m)^\s*---\s*$", 2)
    found = whole.select("path", F.get(parts, F.lit(0)).alias("grammar"), F.posexplode_outer(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n")).alias("line", "sentence"))
    return found.withColumn("tokens", tokenise(F.col("sentence"))).where(F.size("tokens") > 0)


#: What a wrong text gives: a grammar that derives nothing.
NOTHING = Grammar((), (), (), (START,))


def grammar(text: str, epsilons: bool = False, stubs: bool = True) -> tuple[Grammar, str]:
    """The normal form of a document's grammar, kept by text and flags, and a message; a grammar that derives nothing if the text is wrong or has no rule."""
    key = (text, epsilons, stubs)
    if key not in _CACHE:
        try:
            _CACHE[key] = (load(text, epsilons, stubs), "")
        except (ValueError, KeyError) as e:
            _CACHE[key] = (NOTHING, str(e))
    return _CACHE[key]


def normal_file(spark: SparkSession, path: str) -> Grammar:
    """A grammar that is in normal form already."""
    return load_normal("\n".join(r[0] for r in spark.read.text(path).collect()))  # a grammar's lines


def ngram_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows (g, n) of lines `a b c d ::: count`."""
    parts = F.split("value", " ::: ")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.split(F.trim(F.get(parts, F.lit(0))), r"\s+").alias("g"), F.get(parts, F.lit(1)).cast("double").alias("n"))


def pack_automaton(a: Automaton) -> bytes:
    """Little-endian: a JSON head's length, the head (start, costs, tokens), then edges (state, token, state, cost) and finals (state, cost)."""
    tokens = sorted({t for _, t in a.edges})
    ids = {t: i for i, t in enumerate(tokens)}
    head = json.dumps({"start": a.start, "start_cost": a.start_cost, "missing": a.missing, "tokens": tokens, "edges": len(a.edges), "finals": len(a.final)}).encode()
    edges = np.array([(q, ids[t], r, c) for (q, t), (r, c) in sorted(a.edges.items())], dtype="<i4").reshape(-1, 4)
    return struct.pack("<I", len(head)) + head + edges.tobytes() + np.array(sorted(a.final.items()), dtype="<i4").reshape(-1, 2).tobytes()


def unpack_automaton(data: bytes) -> Automaton:
    (n,) = struct.unpack_from("<I", data)
    head = json.loads(data[4 : 4 + n])
    flat = np.frombuffer(data[4 + n :], dtype="<i4")
    edges, finals = flat[: 4 * head["edges"]].reshape(-1, 4), flat[4 * head["edges"] :].reshape(-1, 2)
    if len(finals) != head["finals"]:
        raise ValueError("the automaton's file is cut short")
    return Automaton(head["start"], head["start_cost"], head["missing"], {(int(q), head["tokens"][t]): (int(r), int(c)) for q, t, r, c in edges}, {int(q): int(c) for q, c in finals})


def automaton_file(spark: SparkSession, path: str) -> Automaton:
    return unpack_automaton(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def embedded(resource: str) -> bytes:
    """A gzipped, base64-coded resource."""
    return gzip.decompress(base64.b64decode(resource))


def weights(data: bytes) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file: F32, F16, and I8 with a tensor <name>.scale; shapes and offsets are checked."""
    (n,) = struct.unpack_from("<Q", data)
    head = json.loads(data[8 : 8 + n])
    kinds = {"F32": "<f4", "F16": "<f2", "I8": "i1"}
    out = {}
    for name, t in head.items():
        if name == "__metadata__":
            continue
        lo, hi = t["data_offsets"]
        kind = np.dtype(kinds[t["dtype"]])
        if not 0 <= lo <= hi <= len(data) - 8 - n or hi - lo != kind.itemsize * int(np.prod(t["shape"], dtype=np.int64)):
            raise ValueError(f"tensor {name} doesn't fit its file")
        out[name] = np.frombuffer(data[8 + n + lo : 8 + n + hi], dtype=kind).reshape(t["shape"])
    return {k: v.astype(np.float32) * out[f"{k}.scale"].astype(np.float32) if f"{k}.scale" in out else v for k, v in out.items() if not k.endswith(".scale")}


def write_machines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_machines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
