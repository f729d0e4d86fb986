"""Search setups: a TOML file or dict, checked on the driver, turned into one plan.

Form: ``pool``, ``results``, ``[branches.<name>]`` with ``kind`` (lexical, semantic, sparse) and optional ``weight``, ``[fusion]`` with ``method`` (rrf, sum, none)
and ``k``, optional ``[rerank]`` with ``step`` and ``candidates``, optional ``[rescore]`` alike, ``[aggregation]`` with ``method`` (best chunk, sum of top chunks)
and ``chunks``. Steps (rerankers, rescorers) are looked up in a registry by versioned name.
"""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quern.operators import search as S

BRANCHES, FUSIONS, METHODS = ("lexical", "semantic", "sparse"), ("rrf", "sum", "none"), ("best chunk", "sum of top chunks")
KEYS = {"name", "pool", "results", "branches", "fusion", "rerank", "rescore", "aggregation", "metadata"}
#: name.vN -> function(pairs, queries, texts) -> (query_id, doc_id, ord, score)
STEPS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {"token-overlap.v1": S.overlap_scores}


class SetupError(ValueError):
    pass


@dataclass(frozen=True)
class Setup:
    branches: dict = field(default_factory=dict)
    fusion: dict = field(default_factory=lambda: {"method": "rrf", "k": S.RRF_K})
    aggregation: dict = field(default_factory=lambda: {"method": "best chunk", "chunks": 1})
    rerank: dict | None = None
    rescore: dict | None = None
    pool: int = 200
    results: int = 100
    metadata: bool = False
    name: str = ""

    @classmethod
    def of(cls, raw: dict) -> Setup:
        """Checks a parsed setup; every unknown key, kind, step or combination is an error."""

        def known(part: dict, keys: set[str], where: str) -> None:
            if extra := set(part) - keys:
                raise SetupError(f"unknown keys in {where}: {sorted(extra)}")

        known(raw, KEYS, "the setup")
        made = cls(**raw)
        if not made.branches:
            raise SetupError("no branch")
        for name, b in made.branches.items():
            known(b, {"kind", "weight"}, f"branch {name}")
            if b.get("kind") not in BRANCHES:
                raise SetupError(f"branch {name}: unknown kind {b.get('kind')!r}")
        known(made.fusion, {"method", "k"}, "fusion")
        known(made.aggregation, {"method", "chunks"}, "aggregation")
        if made.fusion.get("method") not in FUSIONS:
            raise SetupError(f"unknown fusion {made.fusion.get('method')!r}")
        if made.fusion["method"] == "none" and len(made.branches) != 1:
            raise SetupError("several branches need a fusion")
        if made.aggregation.get("method") not in METHODS:
            raise SetupError(f"unknown aggregation {made.aggregation.get('method')!r}")
        for part, where in ((made.rerank, "rerank"), (made.rescore, "rescore")):
            if part:
                known(part, {"step", "candidates"}, where)
                if part.get("step") not in STEPS:
                    raise SetupError(f"{where}: unknown step {part.get('step')!r}")
        if made.rerank and made.aggregation["method"] == "sum of top chunks":
            raise SetupError("sums of chunks need scores of one model, so they do not follow reranking")
        return made

    @classmethod
    def load(cls, path: str) -> Setup:
        with open(path, "rb") as f:
            return cls.of(tomllib.load(f))

    def fingerprint(self, *builds: str) -> str:
        """A hash of what the setup says, without its name, and of the index builds that it uses."""
        said = {k: v for k, v in self.__dict__.items() if k != "name"}
        return hashlib.sha256(json.dumps([said, sorted(builds)], sort_keys=True).encode()).hexdigest()

    def description(self) -> str:
        """The setup as JSON with null for what it does not use."""
        return json.dumps(self.__dict__, sort_keys=True)


def answer(setup: Setup, queries: DataFrame, chunks: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """(query_id, doc_id, score, rank) for all queries. ``scores``: by kind of branch, the scores of all chunks (query_id, doc_id, ord, score).

    Branches of one kind share a subplan, which Spark computes once where the exchange is the same."""
    ids = ("doc_id", "ord")
    weights = [float(b.get("weight", 1.0)) for b in setup.branches.values()]
    full = [scores[b["kind"]] for b in setup.branches.values()]
    if setup.fusion["method"] == "sum":
        total = full[0].select("query_id", *ids, (full[0]["score"] * weights[0]).alias("score"))
        for one, weight in zip(full[1:], weights[1:], strict=True):
            total = S.weighted_sum(total, one, weight, ids)
        ranking = S.top(total, setup.pool, ids)
    else:
        cut = [S.top(f, setup.pool, ids, positive=b["kind"] != "semantic") for f, b in zip(full, setup.branches.values(), strict=True)]
        if setup.rescore:
            heads = [c.where(c["rank"] <= setup.rescore["candidates"]) for c in cut]
            pairs = heads[0].select("query_id", *ids)
            for h in heads[1:]:
                pairs = pairs.unionByName(h.select("query_id", *ids))
            new = STEPS[setup.rescore["step"]](pairs.distinct(), queries, chunks)
            cut = [S.rerank(c, new, setup.rescore["candidates"], ids) for c in cut]
        ranking = cut[0] if setup.fusion["method"] == "none" else S.rrf(cut, weights, setup.fusion.get("k", S.RRF_K), ids)
    if setup.rerank:
        n = setup.rerank["candidates"]
        ranking = S.rerank(ranking, STEPS[setup.rerank["step"]](ranking.where(ranking["rank"] <= n), queries, chunks), n, ids)
    if setup.aggregation["method"] == "sum of top chunks":
        return S.sum_of_chunks(ranking, setup.aggregation.get("chunks", 1), setup.results)
    return S.best_chunk(ranking, setup.results)
