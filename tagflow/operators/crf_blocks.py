"""Blocked forward-backward and Viterbi (M2, M4): a sequence of any length is spread over tasks.

A document's tokens are cut into blocks of ``block`` positions, the unit of work.  A block's T x T matrix says how its tokens carry scores from the
tag before it to its last tag, summed over paths (log-sum) or for the best path (max-plus); the first block needs only its vector.  These
products are associative, so a document's blocks are worked on apart, one short scan over its matrices (one row of T * T numbers for each
block) gives the scores at every block's borders, and a second pass over the blocks puts them back: likelihoods, tag marginals, best
paths.  Paths are linked the other way: each block tells which tag before it each of its last tags leads to, and a scan from the
document's end picks them.

Results are those of the whole sequence, on ties too (first index), up to the order of floating-point sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.operators import coded as cd
from tagflow.operators import crf
from tagflow.session import scratch

BLOCK = 1 << 16
NONE = -1e300  # a score that never wins


def cut(tokens: DataFrame, score: crf.Scorer, weights: DataFrame, block: int, labels: str | None = "tag_id") -> DataFrame:
    """(doc_id, block, xs[, ts]) in the shared folder: the tokens of each block in order."""
    key = F.struct("doc_id", F.floor(F.col("pos") / block).cast("long").alias("block"))
    rows = crf.sequences(tokens.withColumn("_k", key), weights, score, key="_k", labels=labels)
    rows = rows.select("_k.doc_id", "_k.block", "xs", *(["ts"] if labels else []))
    path = scratch(tokens.sparkSession, "crf-blocks")
    rows.write.parquet(path)
    return tokens.sparkSession.read.parquet(path)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def summed_matrix(em: np.ndarray, trans: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """(T, T) log-sum scores from the tag before a block to its last tag; with ``start`` (first block) one row."""
    return summed_matrices([em], trans, np.zeros(len(trans)) if start is None else start, np.array([start is not None]))[0]


LOOK = 8  # positions between two looks at whether a matrix's rows have met


def summed_matrices(ems: list[np.ndarray], trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Log-sum matrices of many blocks at once; ``first`` says which begin a document.

    A chain soon forgets the tag before the block: from then on the rows of its matrix differ by constants only, up to rounding (every element by its
    own size), and one row goes on for all; a block whose rows never meet keeps them all.
    """
    t, out, exp_t = len(trans), [None] * len(ems), np.exp(trans)
    for idx in crf._chunks(np.array([len(e) for e in ems])):  # by rising length
        em, lens, reach = crf._by_position([ems[i] for i in idx], np.arange(len(idx)), t)
        top = em.max(axis=2)
        e = np.exp(em - top[:, :, None])
        row, log, more = np.exp(start - start.max())[None] * e[0], start.max() + top[0], np.zeros((len(idx), t))
        wide = np.flatnonzero(~first[idx])
        m, own = exp_t[None] * e[0, wide][:, None], np.repeat(top[0, wide][:, None], t, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(len(em)):
                live = reach[i]
                if i:
                    row[live:] = (row[live:] @ exp_t) * e[i, live:]
                    log[live:] += top[i, live:]
                z = row[live:].sum(axis=1)
                row[live:] /= z[:, None]
                log[live:] += np.log(z)
                if not len(wide):
                    continue
                over = lens[wide] <= i
                if over.any():
                    for k, x, y in zip(wide[over], m[over], own[over]):
                        out[idx[k]] = np.log(x) + y[:, None]
                    wide, m, own = wide[~over], m[~over], own[~over]
                if i:
                    m = (m.reshape(-1, t) @ exp_t).reshape(m.shape) * e[i, wide][:, None]
                    own += top[i, wide][:, None]
                z = m.sum(axis=2)
                m /= z[:, :, None]
                own += np.log(z)
                if i % LOOK == LOOK - 1:
                    met = np.abs(m / m[:, :1] - 1.0).max(axis=(1, 2), initial=0.0) <= 1e-14  # no number: not met
                    row[wide[met]], more[wide[met]], log[wide[met]] = m[met, 0], own[met], 0.0
                    wide, m, own = wide[~met], m[~met], own[~met]
            for k, x, y in zip(wide, m, own):
                out[idx[k]] = np.log(x) + y[:, None]
            ends = np.log(row) + log[:, None]
        for k, i in enumerate(idx):
            if out[i] is None:
                out[i] = ends[k][None] if first[i] else more[k][:, None] + ends[k][None]
            out[i] = np.maximum(out[i], NONE)
    return out


def best_matrices(ems: list[np.ndarray], trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The same for the best path, of many blocks at once; ``first`` says which begin a document.

    Best paths from all tags before a block soon share a tag.  From there on the rows of its matrix differ by constants only, up to rounding, and one
    row goes on for all; a block whose rows never meet keeps them all.
    """
    t, out, into = len(trans), [None] * len(ems), np.ascontiguousarray(trans.T)
    for idx in crf._chunks(np.array([len(e) for e in ems])):  # by rising length
        em, lens = crf._pad([ems[i] for i in idx], np.arange(len(idx)), t)
        row, more = start + em[:, 0], np.zeros((len(idx), t))
        wide = np.flatnonzero(~first[idx])
        m = trans[None] + em[wide, 0][:, None]
        for i in range(em.shape[1]):
            live = int(np.searchsorted(lens, i, "right"))
            if i:
                row[live:] = (row[live:, None] + into).max(axis=2) + em[live:, i]
            if not len(wide):
                continue
            over = lens[wide] <= i
            for k, x in zip(wide[over], m[over]):
                out[idx[k]] = x
            wide, m = wide[~over], m[~over]
            if i:
                best = m[:, :, :1] + trans[0]
                for a in range(1, t):
                    np.maximum(best, m[:, :, a:a + 1] + trans[a], out=best)
                m = best + em[wide, i][:, None]
            top = m.max(axis=2)
            shape = m - top[:, :, None]
            apart = np.abs(shape - shape[:, :1]).max(axis=(1, 2), initial=0.0)
            met = apart <= 1e-15 * (i + 1) * (1.0 + np.abs(top).max(axis=1, initial=0.0))
            row[wide[met]], more[wide[met]] = shape[met, 0], top[met]
            wide, m = wide[~met], m[~met]
        for k, x in zip(wide, m):
            out[idx[k]] = x
        for k, i in enumerate(idx):
            if out[i] is None:
                out[i] = row[k][None] if first[i] else more[k][:, None] + row[k][None]
    return out


TOKENS_AT_ONCE = 1 << 16  # tokens of the blocks that are worked on together


def _mapped(df: DataFrame, one, schema: str, score: crf.Scorer | None = None) -> DataFrame:
    """``one`` turns a row (as a dict) into a dict of the schema's columns, or None; with a ``score`` the row has its emission rows as ``em``."""
    return _mapped_many(df, lambda rows: [one(r) for r in rows], schema, score)


def _mapped_many(df: DataFrame, many, schema: str, score: crf.Scorer | None = None) -> DataFrame:
    """``_mapped`` for a ``many`` that turns a list of rows, of about ``TOKENS_AT_ONCE`` tokens, into a list."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def parts(pdf, weight_rows):
        held, size = [], 0
        for v in zip(*[pdf[c] for c in pdf.columns]):
            r = dict(zip(pdf.columns, v))
            if weight_rows is not None:
                r["em"] = weight_rows(r.pop("xs"))
            held.append(r)
            size += len(r["em"]) if weight_rows is not None else 0
            if size >= TOKENS_AT_ONCE:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches, weight_rows=None):
        for pdf in batches:
            for part in parts(pdf, weight_rows):
                rows = [r for r in many(part) if r is not None]
                if rows:
                    yield pd.DataFrame({n: [r[n] for r in rows] for n in names})

    return df.mapInPandas(run, schema) if score is None else score.map(df, run, schema)


def _per_document(df: DataFrame, *cols: str) -> DataFrame:
    """(doc_id, cols as arrays in the order of blocks)."""
    packed = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block", *cols))).alias("_b"))
    return packed.select("doc_id", F.col("_b.block").alias("block"), *[F.col(f"_b.{c}").alias(c) for c in cols])


def _matrices(blocks: DataFrame, score: crf.Scorer, params: crf.ChainParams, gold: bool = False) -> DataFrame:
    """(doc_id, block, m array<double>[, gold, first, last]): each block's log-sum matrix, and the score inside it of its own tags."""
    return _mapped_many(blocks, lambda rows: _summed(rows, params, gold), "doc_id long, block long, m array<double>" + (", gold double, first int, last int" if gold else ""), score)


def _summed(rows: list[dict], params: crf.ChainParams, gold: bool) -> list[dict]:
    """Blocks (doc_id, block, em[, ts]) with their matrices."""
    trans, out = params.trans, []
    ms = summed_matrices([r["em"] for r in rows], trans, params.start, np.array([r["block"] == 0 for r in rows])) if rows else []
    for r, m in zip(rows, ms):
        out.append({"doc_id": r["doc_id"], "block": r["block"], "m": m.ravel()})
        if gold:
            em, y = r["em"], np.asarray(r["ts"], np.int64)
            out[-1] |= {"gold": float(em[np.arange(len(y)), y].sum() + trans[y[:-1], y[1:]].sum()), "first": int(y[0]), "last": int(y[-1])}
    return out


def _in_chunks(tokens: cd.Coded, weights: DataFrame, score: crf.Scorer, block: int, done, schema: str, labels: str | None = "tag_id") -> DataFrame:
    """``done(blocks)`` for lots of whole documents of coded tokens: a chunk holds all blocks of its documents, so they are linked where they are."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames, rows):
        for pdf in frames:
            for lot in crf._lots(pdf["xs"]):
                part = pdf.iloc[lot]
                ems = crf.lot_rows(list(part["xs"]), rows)
                ys = part["ts"] if labels else [None] * len(part)
                blocks = [{"doc_id": d, "block": k // block, "em": em[k:k + block], "ts": None if y is None else y[k:k + block]}
                          for d, em, y in zip(part["doc_id"], ems, ys) for k in range(0, len(em), block)]
                got = done(blocks)
                yield pd.DataFrame({n: [r[n] for r in got] for n in names})

    return score.map(crf.sequences(tokens, weights, score, labels=labels), run, schema)


def _of_documents(rows: list[dict], *cols: str) -> list[dict]:
    """Rows of blocks, a document's together and in order, as one row for each document."""
    out: list[dict] = []
    for r in rows:
        if not out or out[-1]["doc_id"] != r["doc_id"]:
            out.append({"doc_id": r["doc_id"], "block": [], **{c: [] for c in cols}})
        for c in ("block", *cols):
            out[-1][c].append(r[c])
    return out


def _forward(ms, t: int, join) -> list[np.ndarray]:
    """Score vectors at the last token of each block."""
    out = [np.asarray(ms[0], float)]
    for m in ms[1:]:
        out.append(join(out[-1][:, None] + np.asarray(m, float).reshape(t, t)))
    return out


# --------------------------------------------------------------------------- M2
def loglik(tokens: DataFrame, weights: DataFrame, params: crf.ChainParams, block: int = BLOCK, guard_bytes: int = crf.BROADCAST_GUARD_BYTES) -> DataFrame:
    """M2: (doc_id, loglik) of the tags of sequences of any length."""
    score = crf.scorer(weights, params.n_tags, guard_bytes)
    t, trans, start, end = params.n_tags, params.trans, params.start, params.end

    def one(r):
        z = _lse(_forward(r["m"], t, lambda x: _lse(x, 0))[-1] + end, 0)
        first, last = np.asarray(r["first"]), np.asarray(r["last"])
        gold = np.sum(r["gold"]) + start[first[0]] + end[last[-1]] + trans[last[:-1], first[1:]].sum()
        return {"doc_id": r["doc_id"], "loglik": float(gold - z)}

    if isinstance(tokens, cd.Coded):
        if tokens.whole():
            done = lambda rows: [one(r) for r in _of_documents(_summed(rows, params, True), "m", "gold", "first", "last")]
            return _in_chunks(tokens, weights, score, block, done, "doc_id long, loglik double")
        tokens = cd.token_rows(tokens)
    ms = _matrices(cut(tokens, score, weights, block), score, params, gold=True)
    return _mapped(_per_document(ms, "m", "gold", "first", "last"), one, "doc_id long, loglik double")


def marginals(tokens: DataFrame, weights: DataFrame, params: crf.ChainParams, block: int = BLOCK, guard_bytes: int = crf.BROADCAST_GUARD_BYTES) -> DataFrame:
    """M2: (doc_id, pos, p array<double>), each token's probabilities of its tags (the gradient of log Z by its emissions)."""
    score = crf.scorer(weights, params.n_tags, guard_bytes)
    blocks = cut(tokens, score, weights, block, labels=None)
    t, trans, start, end = params.n_tags, params.trans, params.start, params.end

    def borders(r):
        ahead = _forward(r["m"], t, lambda x: _lse(x, 0))
        behind = [end]
        for m in reversed(r["m"][1:]):
            behind.append(_lse(np.asarray(m, float).reshape(t, t) + behind[-1][None], 1))
        entry = [np.full(t, NONE), *ahead[:-1]]
        return {"doc_id": r["doc_id"], "x": [{"block": int(b), "entry": list(v), "rest": list(w)} for b, v, w in zip(r["block"], entry, reversed(behind))]}

    edge = _mapped(_per_document(_matrices(blocks, score, params), "m"), borders, "doc_id long, x array<struct<block:long,entry:array<double>,rest:array<double>>>")
    edge = edge.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.*")

    def one(r):
        em, n = r["em"], len(r["em"])
        f, g = np.empty((n, t)), np.empty((n, t))
        f[0] = em[0] + (start if r["block"] == 0 else _lse(np.asarray(r["entry"])[:, None] + trans, 0))
        for i in range(1, n):
            f[i] = em[i] + _lse(f[i - 1][:, None] + trans, 0)
        g[n - 1] = np.asarray(r["rest"])
        for i in range(n - 2, -1, -1):
            g[i] = _lse(trans + (em[i + 1] + g[i + 1])[None], 1)
        s = f + g
        return {"doc_id": r["doc_id"], "block": r["block"], "p": list(np.exp(s - _lse(s, 1)[:, None]))}

    got = _mapped(blocks.join(edge, ["doc_id", "block"]), one, "doc_id long, block long, p array<array<double>>", score)
    return got.select("doc_id", "block", F.posexplode("p").alias("i", "p")).select("doc_id", (F.col("block") * block + F.col("i")).cast("int").alias("pos"), "p")


# --------------------------------------------------------------------------- M4 / M5
def _paths(ems: list[np.ndarray], trans: np.ndarray, start: np.ndarray, entry: list):
    """For chunks of blocks, by rising length: (their indexes, lengths, back pointers (b, L, T), the tag before each first tag); ``entry`` has
    the scores of the tags before a block, None where a document begins."""
    t, into = len(trans), np.ascontiguousarray(trans.T)
    for idx in crf._chunks(np.array([len(e) for e in ems])):
        em, lens = crf._pad([ems[i] for i in idx], np.arange(len(idx)), t)
        head = np.array([entry[i] is None for i in idx])
        both = np.stack([np.zeros(t) if entry[i] is None else np.asarray(entry[i], float) for i in idx])[:, None] + into
        came = both.argmax(axis=2)
        s = np.where(head[:, None], start, np.take_along_axis(both, came[:, :, None], 2)[:, :, 0]) + em[:, 0]
        came[head] = -1
        back = np.zeros(em.shape, np.int16)
        for i in range(1, em.shape[1]):
            live = int(np.searchsorted(lens, i, "right"))
            both = s[live:, None] + into
            at = both.argmax(axis=2)  # the first of equals
            back[live:, i] = at
            s[live:] = np.take_along_axis(both, at[:, :, None], 2)[:, :, 0] + em[live:, i]
        yield idx, lens, back, came


def decode(tokens: DataFrame, weights: DataFrame, params: crf.ChainParams, block: int = BLOCK, guard_bytes: int = crf.BROADCAST_GUARD_BYTES) -> DataFrame:
    """M4+M5: (doc_id, block, path array<int>, score), the best path of each document block by block; ``score`` is the part of the
    path's score that its block adds (emissions, the transition into it, start and end)."""
    score = crf.scorer(weights, params.n_tags, guard_bytes)
    t, trans, start, end = params.n_tags, params.trans, params.start, params.end

    def entries(r):
        ahead = _forward(r["m"], t, lambda x: x.max(axis=0))
        last = int(np.argmax(ahead[-1] + end))
        n = len(ahead)
        return {"doc_id": r["doc_id"], "x": [{"block": int(b), "entry": list(v), "last": last if k == n - 1 else -1}
                                             for k, (b, v) in enumerate(zip(r["block"], [np.zeros(t), *ahead[:-1]]))]}

    def best(rows):
        ms = best_matrices([r["em"] for r in rows], trans, start, np.array([r["block"] == 0 for r in rows]))
        return [{"doc_id": r["doc_id"], "block": r["block"], "m": m.ravel()} for r, m in zip(rows, ms)]

    def paths(rows):
        return _paths([r["em"] for r in rows], trans, start, [None if r["block"] == 0 else r["entry"] for r in rows])

    def links(rows):
        """For each last tag of a block the tag before the block."""
        out = []
        for idx, lens, back, came in paths(rows):
            tag = np.repeat(np.arange(t)[None], len(idx), axis=0)
            for i in range(back.shape[1] - 1, 0, -1):
                live = int(np.searchsorted(lens, i, "right"))
                tag[live:] = np.take_along_axis(back[live:, i], tag[live:], 1)
            tag = np.take_along_axis(came, tag, 1).astype(np.int32)
            out += [{"doc_id": rows[k]["doc_id"], "block": rows[k]["block"], "came": c, "last": rows[k]["last"]} for k, c in zip(idx, tag)]
        return out

    def chosen(r):
        out, tag = [], int(r["last"][-1])
        for b, came in zip(reversed(list(r["block"])), reversed(list(r["came"]))):
            out.append({"block": int(b), "tag": tag})
            tag = int(came[tag])
        return {"doc_id": r["doc_id"], "x": out}

    def walked(rows):
        out = []
        for idx, lens, back, came in paths(rows):
            p = np.zeros(back.shape[:2], np.int64)
            p[np.arange(len(idx)), lens - 1] = [rows[k]["tag"] for k in idx]
            for i in range(back.shape[1] - 1, 0, -1):
                live = int(np.searchsorted(lens, i, "right"))
                p[live:, i - 1] = back[np.arange(live, len(idx)), i, p[live:, i]]
            for j, k in enumerate(idx):
                r, q = rows[k], p[j, :lens[j]]
                into = start[q[0]] if r["block"] == 0 else trans[came[j, q[0]], q[0]]
                total = r["em"][np.arange(len(q)), q].sum() + trans[q[:-1], q[1:]].sum() + into + (end[q[-1]] if r["last"] >= 0 else 0.0)
                out.append({"doc_id": r["doc_id"], "block": r["block"], "path": q.astype(np.int32), "score": float(total)})
        return out

    def done(rows):
        """All of it for whole documents."""
        at = {(r["doc_id"], r["block"]): r for r in rows}
        for r in _of_documents(best(rows), "m"):
            for x in entries(r)["x"]:
                at[r["doc_id"], x["block"]] |= {"entry": x["entry"], "last": x["last"]}
        came = sorted(links(rows), key=lambda r: (r["doc_id"], r["block"]))
        for r in _of_documents(came, "came", "last"):
            for x in chosen(r)["x"]:
                at[r["doc_id"], x["block"]]["tag"] = x["tag"]
        return walked(rows)

    schema = "doc_id long, block long, path array<int>, score double"
    if isinstance(tokens, cd.Coded):
        if tokens.whole():
            return _in_chunks(tokens, weights, score, block, done, schema, labels=None)
        tokens = cd.token_rows(tokens)
    blocks = cut(tokens, score, weights, block, labels=None)
    matrices = _mapped_many(blocks, best, "doc_id long, block long, m array<double>", score)
    edge = _mapped(_per_document(matrices, "m"), entries, "doc_id long, x array<struct<block:long,entry:array<double>,last:int>>")
    edge = edge.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.*")
    path = scratch(tokens.sparkSession, "crf-entries")
    blocks.join(edge, ["doc_id", "block"]).write.parquet(path)
    entered = tokens.sparkSession.read.parquet(path)
    linked = _mapped_many(entered, links, "doc_id long, block long, came array<int>, last int", score)
    tags = _mapped(_per_document(linked, "came", "last"), chosen, "doc_id long, x array<struct<block:long,tag:int>>")
    tags = tags.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.*")
    return _mapped_many(entered.join(tags, ["doc_id", "block"]), walked, schema, score)


def predict(tokens: DataFrame, weights: DataFrame, params: crf.ChainParams, block: int = BLOCK, guard_bytes: int = crf.BROADCAST_GUARD_BYTES) -> DataFrame:
    """M5: long predictions (doc_id, pos, pred_id) of sequences of any length."""
    got = decode(tokens, weights, params, block, guard_bytes)
    return got.select("doc_id", "block", F.posexplode("path").alias("i", "pred_id")).select("doc_id", (F.col("block") * block + F.col("i")).cast("int").alias("pos"), "pred_id")
