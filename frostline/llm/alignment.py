"""Alignment of two tokenizers: minimal groups by union-find, pair counts of overlapping tokens.

Tokens of both tokenizers over one text are the nodes of a bipartite graph, tied where their bytes
overlap; the connected components are the minimal groups that both cut alike.  Words that both
tokenizers are sure to cut apart are aligned once for all their occurrences.  Documents are read in
units of bounded size: a unit encodes its texts once, counts its pairs before anything is shuffled, and gets
back the totals of the pairs that it has, so neither pairs of single documents nor the table of all totals is
ever sent to every task.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm.common import kept, materialize, one_thread, table
from frostline.llm.encoding import _ENDS, _ODD, _RUNS, slices


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components, given links u[i] - v[i].

    Roots are hooked to smaller neighbouring roots, all at once, and paths are halved until every node
    points at its root; the roots of a component at least halve in a round.
    """
    parent = np.arange(n)
    while True:
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        apart = low != high
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PairAligner:
    """Aligns space+text under a byte-level vocabulary (A) with text under a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        one_thread()
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        (self.a_line,), self.b_line = self.a.encode("\n", add_special_tokens=False).ids, self.b.piece_to_id("<0x0A>")
        # Cuts before a space and around a line break are sure where no piece of B reaches over one.
        self.cuts = self.b.is_byte(self.b_line) and not any("▁" in p[1:].lstrip("▁") or "\n" in p for i, p in enumerate(names) if not self.b.is_byte(i))
        # A token's text by what stands before it: a group's first of A, its first of B, or one more of either.
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        self.marked = [f";{i}" for i in range(n_a)] + [f",{i}" for i in range(n_a)] + [f"|{i}" for i in range(n_b)] + [f",{i}" for i in range(n_b)]
        self.marked_sizes = np.array(list(map(len, self.marked)), np.int64)

    def pieces(self, text: str | None) -> list[str]:
        """Pieces whose tokens under both are those of space+text; a text that can't be cut is one piece."""
        if not text:
            return []
        if self.cuts and not (text.startswith(_ENDS) or text.endswith(_ENDS) or any(r in text for r in _RUNS) or not _ODD.isdisjoint(text)):
            return (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")[1:]
        return [" " + text]

    def _flat(self, pieces: list[str], encode, one, line: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number by piece): a thousand pieces at once behind line breaks; such with a line break alone."""
        ids, sizes, runs = [], [], []
        for broken, run in itertools.groupby(pieces, key=lambda p: "\n" in p or not self.cuts):
            run = list(run)
            runs += [(broken, run[k : k + 1_000]) for k in range(0, len(run), 1_000)]
        together = iter(encode(["\n" + "\n".join(r) for broken, r in runs if not broken]))
        for broken, run in runs:
            if not broken:
                found = np.array(next(together), np.int64)[lead:]
                at = np.flatnonzero(found == line)
                if len(at) == len(run):
                    ids.append(found[found != line])
                    sizes.append(np.diff(at, append=len(found)) - 1)
                    continue
            each = [np.array(one(p), np.int64) for p in run]
            ids += each
            sizes.append(np.array(list(map(len, each)), np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def align(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """By piece: whether its bytes are those of both; n_a, n_b, groups and links; the links' id pairs, one piece after
        another; its groups as text, each behind a semicolon.  Pieces whose bytes differ have zeros."""
        n_b_ids, raw = len(self.b_bytes), [p.encode() for p in pieces]
        a, n_a = self._flat(pieces, lambda ts: [e.ids for e in self.a.encode_batch_fast(ts, add_special_tokens=False)], lambda p: self.a.encode(p, add_special_tokens=False).ids, self.a_line, 0)
        # B adds the space itself: in front of a run it stands before the first line break.
        alone = lambda p: [self.b_line] if p == "\n" else self.b.encode(p.removeprefix(" "), num_threads=1)
        b, n_b = self._flat(pieces, lambda ts: self.b.encode(ts, num_threads=1) if ts else [], alone, self.b_line, 1)
        ends = np.cumsum(list(map(len, raw)))
        good = np.ones(len(pieces), bool)
        for ids, n, sizes, names in ((a, n_a, self.a_sizes, self.a_bytes), (b, n_b, self.b_sizes, self.b_bytes)):
            whole = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(n)]
            if not np.array_equal(whole, ends) or b"".join(map(names.__getitem__, ids.tolist())) != b"".join(raw):
                parts = np.split(ids, np.cumsum(n)[:-1])
                good &= [b"".join(map(names.__getitem__, p.tolist())) == r for p, r in zip(parts, raw)]
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
            ends = np.cumsum([len(r) if g else 0 for r, g in zip(raw, good.tolist())])
        numbers = np.zeros((len(pieces), 4), np.int64)
        if not len(a):
            return good, numbers, np.zeros(0, np.int64), [""] * len(pieces)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # Between two neighbouring ends lies one token of each: these spans are the links.
        spans = np.union1d(a_ends, b_ends)
        starts = np.concatenate([[0], spans[:-1]])
        u, v = np.searchsorted(a_ends, starts, "right"), np.searchsorted(b_ends, starts, "right")
        root = union_find(len(a) + len(b), u, len(a) + v)
        a_first, b_first = np.diff(root[: len(a)], prepend=-1) != 0, np.diff(root[len(a) :], prepend=-1) != 0
        a_group, b_group = np.cumsum(a_first) - 1, np.cumsum(b_first) - 1
        links_to = np.searchsorted(starts, ends)
        groups_to = np.concatenate([[0], np.cumsum(a_first)])[np.cumsum(n_a)]
        numbers[:, 0], numbers[:, 1], numbers[:, 2], numbers[:, 3] = n_a, n_b, np.diff(groups_to, prepend=0), np.diff(links_to, prepend=0)
        # Tokens in the order of the text: a group's of A before its of B.
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group))])
        a_until = np.cumsum(np.bincount(a_group))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + b_before[a_group]] = np.where(a_first, a, a + len(self.a_bytes))
        code[np.arange(len(b)) + a_until[b_group]] = 2 * len(self.a_bytes) + np.where(b_first, b, b + n_b_ids)
        joined = "".join(map(self.marked.__getitem__, code.tolist()))
        chars = np.concatenate([[0], np.cumsum(self.marked_sizes[code])])[np.cumsum(n_a + n_b)].tolist()
        return good, numbers, a[u] * n_b_ids + b[v], [joined[x:y] for x, y in zip([0, *chars], chars)]


def aligner(a_path: str, b_path: str) -> PairAligner:
    """The worker process's own aligner, kept from task to task."""
    return kept("alignment", (a_path, b_path), lambda: PairAligner(a_path, b_path))


class Unit:
    """What a task has read so far: its distinct pieces, each aligned once, and how often each was met."""

    def __init__(self, al: PairAligner):
        self.al, self.name, self.read = al, uuid.uuid4().hex, 0
        self.number: dict[str, int] = {}
        self.good, self.numbers = np.zeros(0, bool), np.zeros((0, 4), np.int64)
        self.keys, self.texts, self.met = [], [], np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 50_000):
            part = pieces[i : i + 50_000]
            good, numbers, keys, texts = self.al.align(part)
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
            self.good, self.numbers = np.concatenate([self.good, good]), np.concatenate([self.numbers, numbers])
            self.keys.append(keys)
            self.texts += texts

    def add(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[bytes]]:
        """Per text: its numbers, the hash of its groups, its pieces' numbers (bytes by plane, the lowest first).

        A text with a piece whose bytes differ is aligned whole.
        """
        lists = list(map(self.al.pieces, texts))
        self._learn(list(set().union(*lists).difference(self.number)))
        if not self.good.all():
            bad = {p for p, i in self.number.items() if not self.good[i]}
            lists = [["".join(c)] if len(c) > 1 and not bad.isdisjoint(c) else c for c in lists]
            self._learn(list({c[0] for c in lists if len(c) == 1 and c[0] not in self.number}))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        rows = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        met = np.bincount(rows, minlength=len(self.number))
        met[: len(self.met)] += self.met
        self.met = met
        self.read += sum(len(t) for t in texts if t)
        ends = np.cumsum(sizes).tolist()
        text, get = rows.tolist(), self.texts.__getitem__
        spans = list(zip([0, *ends], ends))
        groups = ("".join(map(get, text[x:y]))[1:] for x, y in spans)
        hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        return _sums(self.numbers[rows], sizes), hashes, [rows[x:y].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x, y in spans]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unit's id pairs in ascending order, how often each is linked, and each link's place among them, piece after piece."""
        keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, at, np.repeat(self.met, self.numbers[:, 3]))
        return keys, n, at


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``sizes`` of them at a time."""
    upto, ends = np.zeros((len(values) + 1, values.shape[1]), np.int64), np.cumsum(sizes)
    np.cumsum(values, axis=0, out=upto[1:])
    return upto[ends] - upto[ends - sizes]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _in_units(docs: DataFrame, a_path: str, b_path: str, chars: int) -> DataFrame:
    """Stored rows of three kinds by unit (what one task reads up to ``chars`` characters): 0 its pairs with
    their counts (pair, n), 1 its pieces' links as places among its pairs (n: order; links, sizes), 2 its documents
    with their numbers and pieces.  As a unit's name is stored with its rows, later passes find it alike, however
    their tasks are cut; texts are read and encoded once.
    """
    long, binary = (lambda c, t: F.lit(None).cast(t).alias(c)), ("links", "sizes")
    schema = docs.select(F.lit("").alias("unit"), F.lit(0).alias("kind"), F.expr("nullif(doc_id, doc_id)").alias("doc_id"), *[long(c, "long") for c in ("pair", "n", *NUMBERS)], long("groups_sha256", "string"), *[long(c, "binary") for c in binary]).schema
    names = schema.names

    def rows(unit, kind, m, **columns):
        empty = {"doc_id": columns.pop("id_type", None), "groups_sha256": pa.string(), "links": pa.binary(), "sizes": pa.binary()}
        made = {"unit": pa.array([unit.name] * m), "kind": pa.array([kind] * m, pa.int32())} | columns
        return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(m, empty.get(c, pa.int64())) for c in names], names)

    def ended(unit, id_type):
        keys, n, at = unit.pairs()
        for i in range(0, len(keys), 10_000):
            yield rows(unit, 0, len(keys[i : i + 10_000]), id_type=id_type, pair=pa.array(keys[i : i + 10_000]), n=pa.array(n[i : i + 10_000]))
        sizes = unit.numbers[:, 3]
        to = np.concatenate([[0], np.cumsum(sizes)])
        for k in range(0, len(sizes), 20_000):
            end = min(k + 20_000, len(sizes))
            yield rows(unit, 1, 1, id_type=id_type, n=pa.array([k], pa.int64()), links=pa.array([at[to[k] : to[end]].astype("<u4").tobytes()]), sizes=pa.array([sizes[k:end].astype("<u4").tobytes()]))

    def units(batches):
        al, id_type = aligner(a_path, b_path), None
        unit = Unit(al)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            id_type = ids.type
            for a, b in slices(texts, min(chars, 4_000_000)):
                numbers, hashes, pieces = unit.add(texts[a:b])
                columns = {c: pa.array(numbers[:, i]) for i, c in enumerate(NUMBERS)}
                yield rows(unit, 2, b - a, doc_id=ids[a:b], groups_sha256=pa.array(hashes, pa.string()), links=pa.array(pieces, pa.binary()), **columns)
                if unit.read >= chars:
                    yield from ended(unit, id_type)
                    unit = Unit(al)
        if id_type is not None:
            yield from ended(unit, id_type)

    return materialize(docs.select("doc_id", "text").mapInArrow(units, schema), "units")


def _totals(units: DataFrame, n_b: int) -> DataFrame:
    """(unit, pair, total, best): for each unit's pairs their count over the corpus, and whether it is their B id's highest.

    The highest counts are at most one row an id of B, so they are broadcast.
    """
    pairs = units.where("kind = 0").select("unit", "pair", "n")
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % n_b)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    marked = totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    return pairs.select("unit", "pair").join(marked, "pair")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, chars: int = 16_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A is a byte-level vocabulary of the ``tokenizers`` library, applied to space+text, B a sentencepiece
    model, applied to the text.  Strings of special tokens are ordinary text.  Null and empty texts, and
    those whose joined A or B bytes differ from space+text, have zeros, an empty groups_sha256 and no part in
    the counts.  Repeated rows count each; a null doc_id stays null; other columns are ignored, whatever
    their names; very long texts are read whole (``chars`` bounds what is read into a unit beyond the last
    text); an empty table gives an empty result.
    """
    units = _in_units(docs, a_path, b_path, chars)
    n_b = len(aligner(a_path, b_path).b_bytes)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    id_type = docs.schema["doc_id"].dataType
    known = _totals(units, n_b).select("unit", F.lit(0).alias("kind"), none("doc_id", id_type), "pair", none("n", "long"), *[none(c, "long") for c in NUMBERS], none("groups_sha256", "string"), none("links", "binary"), none("sizes", "binary"), "total", "best")
    whole = units.where("kind > 0").select("*", none("total", "long"), none("best", "boolean"))
    schema = docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in (*NUMBERS, "n_best", "count_sum")], F.lit("").alias("groups_sha256")).schema

    def score(batches):
        unit = None
        for batch in batches:
            names, kinds = batch.column("unit").to_pylist(), batch.column("kind").to_pylist()
            start = 0
            for (name, kind), run in itertools.groupby(zip(names, kinds)):
                end = start + sum(1 for _ in run)
                part, start = batch.slice(start, end - start), end
                if name != unit:  # a unit's pairs, in ascending order, and its pieces come before its documents
                    unit, pairs, pieces, table = name, [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], None
                if kind == 0:
                    pairs.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("best", "total")], axis=1))
                elif kind == 1:
                    if isinstance(pairs, list):
                        pairs = np.concatenate(pairs)
                    for links, sizes in zip(part.column("links").to_pylist(), part.column("sizes").to_pylist()):
                        pieces.append(_sums(pairs[np.frombuffer(links, "<u4")], np.frombuffer(sizes, "<u4").astype(np.int64)))
                else:
                    if table is None:
                        table = np.concatenate(pieces)
                    raw = part.column("links").to_pylist()
                    rows = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(r, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for r in raw]])
                    sums = _sums(table[rows], np.array([len(r) // 4 for r in raw], np.int64))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in NUMBERS), pa.array(sums[:, 0]), pa.array(sums[:, 1]), part.column("groups_sha256")], [f.name for f in schema])

    return known.unionByName(whole).repartition("unit").sortWithinPartitions("unit", "kind", "pair", "n").mapInArrow(score, schema)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
