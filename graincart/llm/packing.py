"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and an end id, cut into pieces of at most ``CAPACITY`` ids. Pieces are
dealt to islands of a few thousand. An island's individuals are packings; crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold duplicates of them, and
puts the displaced pieces back by best fit; mutation dissolves the emptiest bins. An island stops at
the least number of bins that its tokens could fill, or after ``PATIENCE`` generations without a
better packing. Between epochs each island's elite bins migrate to the next island in a ring. As
islands hold different pieces, a bin travels as its pattern, the multiset of its lengths, and
settles where pieces of those lengths are.

Then islands merge: each keeps its bins, but for the emptiest ones (those below ``FULL``, up to half
of its tokens and pieces, one at least), whose pieces meet again in at most half as many islands,
until one island is left. So the loose tokens halve with each turn, no task holds more than an
island, and the number of part-filled bins does not grow with the number of islands.

Defined results: null texts are empty and give one piece, the end id; repeated rows are pieces of
their own; null ids are carried along; of equally good packings the first found stays, and all
random choices are seeded; an empty table gives an empty result; ``pack`` keeps the other columns of
its items, of any name, and its result columns replace columns of the same name.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincart.llm.common import boxed, durable, kept

CAPACITY, END_ID = 4096, 1
#: Pieces of an island, in expectation; bins that migrate from it.
ISLAND, ELITE = 3000, 16
#: Individuals of an island; generations of an epoch at most, and without a better packing.
POPULATION, GENERATIONS, PATIENCE = 8, 120, 30
#: A bin with at least this share filled is kept when islands merge.
FULL = 0.998
#: Words and parts of words whose ids a Python worker remembers, in each of two generations.
REMEMBERED = 600_000


# How the tokenizer whose words ``Encoder`` prepares itself cuts a text, and its normalisation.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE, _LETTER, _NUMBER, _SIGN = range(4)


def _byte_letters() -> dict[int, str]:
    """Letters that stand for the UTF-8 bytes of the Latin-1 characters: themselves where printable, else those from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def _latin(text: str) -> bytes | None:
    """The text a byte a character if all are Latin-1's: these have no marks to compose, and Python and the tokenizer lower-case them alike."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


class Encoder:
    """Ids of texts by a tokenizer that never joins text across white space, part by part from memory.

    If the tokenizer is of the kind that ends its words with a suffix, texts of Latin-1 letters
    are cut into its parts (runs of letters, digits, signs) here, all texts of a call at once; each
    distinct part is looked up once, and new ones go to the bare model many at a time, in its byte
    letters. Other texts go word by word, new words of other letters through the whole tokenizer.
    Memory has two generations: entries of a full young one become the old one, and return to the
    young one when they are met again, so frequent ones stay and rare ones go.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        told = json.loads(self.tokenizer.to_str())
        # what only the tokenizer itself may see: its special tokens, and white space to Python that is none to it
        special = [unicodedata.normalize("NFC", t["content"]).lower() for t in told["added_tokens"]]
        self.odd = [raw for c in (*special, *_SEPARATORS) if (raw := _latin(c)) is not None]
        cut = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        normal = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        suffix = told["model"].get("end_of_word_suffix")
        self.bare = None
        if suffix and normal == _NORMAL and [c.get("type") for c in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": _CUT} and cut[0]["invert"] and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"]):
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters = _byte_letters()
            vocabulary = self.bare.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            latin = [chr(c) for c in range(256)]
            self.lower = "".join(latin).lower().encode("latin-1")
            self.kinds = bytes(_SPACE if c.isspace() else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _SIGN for c in latin)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self._ids(texts, self._by_words)

    def _ids(self, texts: list[str], others: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of texts, or words: by their parts where these can be cut here, by ``others`` elsewhere."""
        raw = [self._plain(t) for t in texts]
        plain = iter(self._by_parts([r for r in raw if r is not None]))
        rest = iter(others([t for t, r in zip(texts, raw, strict=True) if r is None]))
        return [next(rest if r is None else plain) for r in raw]

    def _plain(self, text: str) -> bytes | None:
        """The text lower-cased, a byte a character, if it can be cut into parts here."""
        if not self.bare or (raw := _latin(text)) is None:
            return None
        raw = raw.translate(self.lower)
        return None if any(c in raw for c in self.odd) else raw

    def _by_parts(self, raw: list[bytes]) -> list[bytes]:
        import pyarrow as pa

        if not raw:
            return []
        letters = b"\n".join([*raw, b"\n\n"])
        kinds = np.frombuffer(letters.translate(self.kinds), np.uint8)
        letters = np.frombuffer(letters, np.uint8)
        solid = kinds != _SPACE
        begins = solid.copy()  # where a part begins: at another kind than before, and at each number
        begins[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
        at = np.flatnonzero(begins & (letters == ord("'")))  # a sign that begins with one of the endings is cut after it
        one, two = letters[at + 1], letters[at + 2]
        for size, ending in ((2, np.isin(one, list(b"stmd"))), (3, np.logical_or.reduce([(one == a) & (two == b) for a, b in (b"re", b"ve", b"ll")]))):
            begins[at[ending] + 1] = False
            begins[at[ending] + size] = solid[at[ending] + size]
        stops = np.searchsorted(np.flatnonzero(begins), np.cumsum([len(r) + 1 for r in raw], dtype=np.int64))
        bounds = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters[solid])]).dictionary_encode()
        if not len(parts):
            return [b""] * len(raw)
        _, places, data = parts.dictionary.buffers()
        distinct = np.insert(np.frombuffer(data, np.uint8), np.frombuffer(places, np.int64)[1 : len(parts.dictionary)], ord("\n")).tobytes().decode("latin-1").split("\n")
        ids = pa.array(self._known(distinct, self._learn_parts), pa.large_binary()).take(parts.indices)
        _, places, data = ids.buffers()
        places = np.frombuffer(places, np.int64)[np.r_[0, stops]].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(places, places[1:], strict=False)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        found = iter(self._known([w for words in split for w in words], self._learn_words))
        return [b"".join(islice(found, len(words))) for words in split]

    def _known(self, words: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of each word or part from memory, those of new ones by ``learn``."""
        found = list(map(self.young.get, words))  # each is looked up once; the few holes are filled later
        holes = [k for k, ids in enumerate(found) if ids is None]
        missing = {words[k] for k in holes}
        fresh = {w: b for w in missing if (b := self.old.get(w)) is not None} if self.old else {}
        new = list(missing.difference(fresh))
        fresh.update(zip(new, learn(new), strict=True))
        if len(self.young) + len(fresh) > self.remembered:
            self.old, self.young = self.young, {}
        self.young.update(fresh)
        for k in holes:
            found[k] = fresh[words[k]]
        return found

    def _learn_words(self, words: list[str]) -> list[bytes]:
        return self._ids(words, self._learn_whole)

    def _learn_whole(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts; a part alone has the same ids as in a word."""
        out = []
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some).translate(self.letters | {32: " "})], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some) and stops[-1] == ids.nbytes:
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:  # a part without an own end
                out += self._learn_whole(some)
        return out

    def _split(self, text: str) -> list[str]:
        if any(c in text for c in _SEPARATORS):
            return "".join("\n" if c.isspace() and c not in _SEPARATORS else c for c in text).split("\n")
        return text.split()


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task until another operator's tasks come."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Encoder(path)

    return kept(f"encoder {path}", make)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; ``tokenizer``: a file's path, or its name among the public ones."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        import public_tokenizers

        encode = encoder(tokenizer if os.path.sep in tokenizer else str(public_tokenizers.path(tokenizer))).encode
        for batch in batches:
            texts, begin = batch.column(1).to_pylist(), 0
            while begin < len(texts):
                stop, size = begin, 0
                while stop < len(texts) and size < 1 << 22:
                    size += len(texts[stop] or "")
                    stop += 1
                which, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in texts[begin:stop]]), begin):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        which.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32"])
                begin = stop

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """One individual: bins as lists of piece numbers."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity, self.bins, self.loads = lengths, capacity, [], []

    def insert(self, items: list[int]) -> None:
        """Best fit: each item, longest first, goes to the fullest bin that still holds it."""
        lengths, capacity = self.lengths, self.capacity
        room = sorted((capacity - load, k) for k, load in enumerate(self.loads) if load < capacity)
        for item in items:
            need = lengths[item]
            at = bisect_left(room, (need, -1))
            if at < len(room):
                left, k = room.pop(at)
                self.bins[k].append(item)
            else:
                left, k = capacity, len(self.bins)
                self.bins.append([item])
                self.loads.append(0)
            self.loads[k] += need
            if left > need:
                insort(room, (left - need, k))

    def add(self, bin_: list[int]) -> None:
        self.bins.append(list(bin_))
        self.loads.append(sum(self.lengths[i] for i in bin_))

    def fitness(self) -> float:
        """Mean squared fill: fewer, fuller bins are better."""
        return sum((x / self.capacity) ** 2 for x in self.loads) / max(1, len(self.loads))


def _cross(a: Packing, injected: list[list[int]], rng: np.random.Generator, mutate: int) -> Packing:
    """``a`` with whole bins of another parent: bins that hold their pieces go, what that displaces is best-fitted."""
    child = Packing(a.lengths, a.capacity)
    owned = {i for b in injected for i in b}
    displaced: list[int] = []
    for b, load in zip(a.bins, a.loads, strict=True):
        if owned.isdisjoint(b):
            child.bins.append(list(b))
            child.loads.append(load)
        else:
            displaced += [i for i in b if i not in owned]
    for b in injected:
        child.add(b)
    if mutate and len(child.bins) > mutate:
        for k in sorted(np.argpartition(child.loads, mutate)[:mutate].tolist(), reverse=True):
            displaced += child.bins.pop(k)
            child.loads.pop(k)
    displaced.sort(key=lambda i: (-a.lengths[i], i))
    child.insert(displaced)
    return child


def _settle(patterns: list[tuple[int, ...]], lengths: list[int]) -> list[list[int]]:
    """Bins of own pieces for immigrant patterns, as far as pieces of those lengths are there."""
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stock.setdefault(n, []).append(i)
    out = []
    for pattern in patterns:
        need = {n: pattern.count(n) for n in set(pattern)}
        if all(len(stock.get(n, ())) >= k for n, k in need.items()):
            out.append([stock[n].pop() for n in pattern])
    return out


def evolve(
    lengths: list[int], start: list[list[int]] | None = None, immigrants: list[tuple[int, ...]] = (), capacity: int = CAPACITY, seed: int = 0,
    population: int = POPULATION, generations: int = GENERATIONS, patience: int = PATIENCE, history: list[str] | None = None,
) -> Packing:
    """The best packing that an island finds; ``start``: the bins it had reached before; ``history``: takes notes."""
    rng = np.random.default_rng(seed)
    note = history.append if history is not None else lambda _: None
    floor = -(-sum(lengths) // capacity)
    people: list[Packing] = []
    rank = lambda p: (len(p.bins), -p.fitness())
    for k in range(population):
        one = Packing(lengths, capacity)
        if k == 0 and start:
            for b in start:
                one.add(b)
        elif k == (1 if start else 0):
            one.insert(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)))
        else:  # nearly by length: another order of similar pieces
            noise = rng.uniform(0.85, 1.15, len(lengths))
            one.insert(sorted(range(len(lengths)), key=lambda i: -lengths[i] * noise[i]))
        people.append(one)
        if len(one.bins) <= floor:
            note("floor")
            return one
    people.sort(key=rank)
    settled = _settle(list(immigrants), lengths) if immigrants else []
    idle = 0
    for turn in range(generations):
        if len(people[0].bins) <= floor or idle >= patience:
            break
        # two parents, better ones more often
        i, j = sorted(int(x) for x in rng.choice(len(people), 2, replace=False)) if len(people) > 1 else (0, 0)
        a, b = (people[i], people[j]) if turn % 2 else (people[j], people[i])
        if turn == 0 and settled:
            a, injected = people[0], settled
            note("migrants")
        else:
            well = [k for k, load in enumerate(b.loads) if load >= 0.97 * capacity and len(b.bins[k]) > 1] or list(range(len(b.bins)))
            injected = [b.bins[k] for k in rng.permutation(well)[: max(1, len(well) // 3)]]
            note("crossover")
        child = _cross(a, injected, rng, mutate=max(2, len(a.bins) // 50))
        idle += 1
        if rank(child) < rank(people[-1]) and rank(child) not in map(rank, people):
            if rank(child) < rank(people[0]):
                idle = 0
                note("better")
            people[-1] = child
            people.sort(key=rank)
    return people[0]


_STATE = "uid long, island long, length long, bin int, rises boolean, pattern array<int>"


def rising(loads: list[int], sizes: list[int], capacity: int, full: float = FULL) -> list[int]:
    """Bins whose pieces go on when islands merge: the emptiest not full, up to half of the tokens and of the pieces, one at least."""
    order = sorted((k for k, load in enumerate(loads) if load < full * capacity), key=lambda k: (loads[k], k))
    tokens = np.cumsum([loads[k] for k in order])
    pieces_ = np.cumsum([sizes[k] for k in order])
    return order[: max(1, int(((2 * tokens <= sum(loads)) & (2 * pieces_ <= sum(sizes))).sum()))]


def _epoch(capacity: int, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        island = int(group["island"].iloc[0])
        own = group[group["uid"].notna()].sort_values("uid")
        lengths = own["length"].astype(int).tolist()
        if not lengths:
            return pd.DataFrame({"uid": [], "island": [], "length": [], "bin": [], "rises": [], "pattern": []})
        start = None
        if own["bin"].notna().all():
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(own["bin"].astype(int)):
                bins.setdefault(b, []).append(i)
            start = list(bins.values())
        immigrants = [tuple(map(int, p)) for p in group.loc[group["uid"].isna(), "pattern"]]
        best = evolve(lengths, start, sorted(immigrants), capacity, seed=seed * 1_000_003 + island)
        of, up = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), bool)
        for k, b in enumerate(best.bins):
            of[b] = k
        for k in rising(best.loads, [len(b) for b in best.bins], capacity):
            up[best.bins[k]] = True
        out = pd.DataFrame({"uid": own["uid"].astype("int64").to_numpy(), "island": island, "length": lengths, "bin": of, "rises": up, "pattern": None})
        elite = sorted((k for k, b in enumerate(best.bins) if len(b) > 1), key=lambda k: (-best.loads[k], k))[:ELITE]
        moving = pd.DataFrame({"uid": pd.array([None] * len(elite), dtype="Int64"), "island": island, "length": 0, "bin": 0, "rises": False, "pattern": [[lengths[i] for i in best.bins[k]] for k in elite]})
        return pd.concat([out.astype({"uid": "Int64"}), moving], ignore_index=True) if elite else out

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """``items`` (with ``length``) plus sequence_id and offset: no sequence over ``capacity``, offsets gapless."""
    rows = items.select(boxed(items, "sequence_id", "offset"), F.col("length").cast("long").alias("length"))
    keyed = durable(rows.withColumn("uid", F.monotonically_increasing_id()))
    whole = keyed.where(F.col("length") >= capacity).select("uid", (F.col("uid") * 2 + 1).alias("sequence_id"))
    loose = keyed.where(F.col("length") < capacity).select("uid", "length")
    placed, islands, turn = whole, None, 0
    while True:
        total = loose.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
        if not total.n:
            break
        # an island has pieces for some bins, and there are at most half as many as in the turn before
        wanted = min(-(-total.n // island), total.tokens // (4 * capacity))
        islands = max(1, wanted if islands is None else min(wanted, islands // 2))
        state = loose.select("uid", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(islands)).alias("island"), "length", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("array<int>").alias("pattern"))
        state = durable(state.groupBy("island").applyInPandas(_epoch(capacity, 2 * turn), _STATE))
        if islands > 1:  # elites go to the next island in the ring, and a second epoch follows
            moved = state.withColumn("island", F.when(F.col("uid").isNull(), (F.col("island") + 1) % islands).otherwise(F.col("island")))
            state = durable(moved.groupBy("island").applyInPandas(_epoch(capacity, 2 * turn + 1), _STATE))
        name = ((F.lit(turn).cast("long") * (1 << 34) + F.col("island")) * (1 << 20) + F.col("bin")) * 2
        stays = F.col("uid").isNotNull() & (~F.col("rises") if islands > 1 else F.lit(True))
        placed = placed.unionByName(state.where(stays).select("uid", name.alias("sequence_id")))
        if islands == 1:
            break
        loose, turn = state.where("uid is not null and rises").select("uid", "length"), turn + 1
    # a sequence holds at most ``capacity`` pieces, as each has at least one id
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    return keyed.join(placed, "uid").select("row.*", "sequence_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
