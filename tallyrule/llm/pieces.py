"""SentencePiece encoding and decoding by a weighted transducer."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units that a worker remembers, and as many older ones, of which those not met again are then forgotten; neighbours.
REMEMBERED = 200_000
FOLLOWS = 300_000


def rewrites(charsmap: bytes) -> dict[str, str]:
    """What a model's character map rewrites: the keys of its double-array trie with their replacements.

    The map is the trie's length in bytes, its 32-bit units, and the replacements, each ended by a zero."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, pool = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64), charsmap[4 + size :]
    base = lambda u: (u >> 10) << ((u & 512) >> 6)
    labels, found, stack = np.arange(1, 256), {}, [(b"", int(base(units[0])))]
    while stack:
        key, at = stack.pop()
        places = at ^ labels
        inside = places < len(units)
        for c, place in zip(labels[inside], places[inside][: inside.sum()], strict=True):
            unit = int(units[place])
            if unit & 0x800000FF != c:
                continue
            to = place ^ base(unit)
            if unit >> 8 & 1:
                value = int(units[to]) & 0x7FFFFFFF
                found[key + bytes([c])] = pool[value : pool.index(b"\0", value)]
            stack.append((key + bytes([c]), int(to)))
    return {k.decode(): v.decode() for k, v in found.items()}


#: Characters of a text that are cut out at a time when a trie is followed.
AHEAD = 64


def trie_of(words) -> dict:
    """Nested {character: [the word that ends there or None, what leads on]}."""
    root: dict = {}
    for w in words:
        node = root
        for c in w[:-1]:
            node = node.setdefault(c, [None, {}])[1]
        node.setdefault(w[-1], [None, {}])[0] = w
    return root


def longest(trie: dict, text: str, at: int) -> str | None:
    """The longest word of a trie at a place of a text; only as much of the text is looked at as the trie leads on."""
    found = None
    while at < len(text):
        for c in text[at : at + AHEAD]:
            if (step := trie.get(c)) is None:
                return found
            word, trie = step
            found = word or found
        at += AHEAD
    return found


class Normaliser:
    """The transducer from a text to what the pieces are read from.

    Its arcs rewrite the longest key of the character map, copy a user-defined piece, or copy a character. Its states say
    whether the text so far is empty or ends with a space; in them, a model that removes extra spaces writes none. At the
    start or at the end it writes the dummy space, and every space as U+2581 if the model escapes them."""

    def __init__(self, spec, users: list[str], suffix: bool):
        self.map, self.users = rewrites(spec.precompiled_charsmap), trie_of(users)
        self.keys = trie_of(self.map)
        self.squeeze, self.dummy, self.suffix = spec.remove_extra_whitespaces, spec.add_dummy_prefix, suffix
        self.space = SPACE if spec.escape_whitespaces else " "
        self.plain = not (self.map or self.squeeze)

    def __call__(self, text: str) -> str:
        if not self.plain:
            text = self.rewritten(text)
        if not text:
            return ""
        text = text.replace(" ", self.space)
        return text if not self.dummy else text + self.space if self.suffix else self.space + text

    def rewritten(self, text: str) -> str:
        out, at, spaced = [], 0, self.squeeze
        while at < len(text):
            if word := longest(self.users, text, at):
                read = write = word
            else:
                read = longest(self.keys, text, at) or text[at]
                write = self.map.get(read, read)
            at += len(read)
            if spaced:
                write = write.lstrip(" ")
            if write:
                out.append(write)
                spaced = self.squeeze and write[-1] == " "
        joined = "".join(out)
        return joined.rstrip(" ") if self.squeeze else joined


class Transducer:
    """Normaliser, pieces and byte fallback of a model, composed with a text as the text is read.

    Normaliser: see there. Pieces: arcs from position to position of the normalised text, which write a piece's id. A
    character that no piece holds has an arc that writes its bytes, or the unknown id. The weights are tropical: a path
    weighs the sum of its arcs, and the lightest path is the encoding (shortest).

    - unigram models: an arc weighs minus its piece's score;
    - BPE models: an arc weighs 0 if it may follow the arc before it, else infinity. A sequence of pieces is what
      merging by rank gives if and only if that holds for each two neighbours, so exactly one path of finite weight
      reaches each position, and a state is a position with the last piece on its path.

    Pieces that cross from a character into a space don't exist in most models (checked here), so the machine is composed
    with one unit - spaces with the characters after them - at a time, and units seen before are remembered."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(model)
        kind = m.trainer_spec.model_type
        self.bpe = kind == 2
        if kind not in (1, 2) or self.bpe and any(p.type == UNUSED for p in m.pieces):
            raise ValueError("only unigram models, and BPE models without unused pieces, are handled")
        users = [p.piece for p in m.pieces if p.type == USER]
        self.normalise = Normaliser(m.normalizer_spec, users, m.trainer_spec.treat_whitespace_as_suffix)
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER)}
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_ids = frozenset(self.bytes.values())
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        if self.bytes and len(self.bytes) != 256:
            raise ValueError("byte fallback needs 256 byte pieces")
        self.worst, best = 10.0 - min(self.score.values(), default=0.0), max(self.score.values(), default=0.0)
        self.cost = {p: -x for p, x in self.score.items()} | {p: 0.1 - len(p.encode()) * best for p in users}
        self.out = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type != UNKNOWN else b" \xe2\x81\x87 " for p in m.pieces]
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids) or self.normalise.space != SPACE
        alone = "".join(c for c in map(chr, range(32)) if not any(c in p for p in self.ids))
        self.units = re.compile("(?s).+" if inner else f"[{re.escape(alone)}]|{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        #: Merging by rank leaves user-defined pieces alone, and does not cross them.
        self.frozen = re.compile("(" + "|".join(map(re.escape, sorted(users, key=len, reverse=True))) + ")").split if self.bpe and users else None
        self.users = frozenset(users) if self.bpe else frozenset()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        #: By score, the best is 0; pieces of one character come before all merges and have none.
        merged = [p for p in self.score if len(p) > 1] if self.bpe else []
        order = {x: i for i, x in enumerate(sorted({self.score[p] for p in merged}, reverse=True))}
        self.rank = {p: order[self.score[p]] for p in merged}
        met = Counter(self.rank.values())
        self.tied = {p for p, i in self.rank.items() if met[i] > 1}
        self.code = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        #: The pieces as a trie; of a BPE model those that merging makes.
        self.trie = trie_of(p for p in self.score if len(p) == 1 or self.last_merge(p)) if self.bpe else trie_of(self.ids)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging the best-ranked neighbours, the left ones first, makes of a text, and its last merge."""
        parts, made = list(text), None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], np.inf), i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            made = parts[best], parts[best + 1]
            parts[best : best + 2] = [made[0] + made[1]]
        return parts, made

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts of which merging by rank makes a piece last; None if it never makes it."""
        if piece not in self.parts:
            parts, made = self.merge(piece)
            self.parts[piece] = made if len(parts) == 1 else None
        return self.parts[piece]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging by rank keeps two neighbours apart.

        The merges that made them are undone, latest first; at no time may the parts that then touch have been a better
        merge than the one undone. Of equal merges the left one comes first."""
        if (found := self.follows.get((a, b))) is None:
            rank, limit, left, right = self.rank, np.inf, a, b
            while a not in self.tied and b not in self.tied:
                if rank.get(left + right, np.inf) < limit:
                    found = False
                    break
                of_left, of_right = rank.get(left, -1), rank.get(right, -1)
                if of_left > of_right:
                    limit, left = of_left, self.last_merge(left)[1]
                elif of_right < 0:
                    found = True
                    break
                else:
                    limit, right = of_right + 1, self.last_merge(right)[0]
            if found is None:  # among equal ranks time isn't told by rank: merge them
                found = self.merge(a + b)[0] == [a, b]
            self.follows[a, b] = found
        return found

    def arcs(self, unit: str, start: int) -> list[str]:
        """What the arcs from a position read, the shortest first: pieces, and a character that is none."""
        node, found = self.trie, []
        for at in range(start, len(unit)):
            if (step := node.get(unit[at])) is None:
                break
            if step[0]:
                found.append(step[0])
            node = step[1]
        return found if found and len(found[0]) == 1 else [unit[start], *found]

    def weight(self, before: str | None, arc: str) -> float:
        """The tropical weight of an arc after another one."""
        if not self.bpe:
            return self.cost.get(arc, self.worst)
        if before is None:
            return 0.0
        ok = self.follows.get((before, arc))
        return 0.0 if (self.may_follow(before, arc) if ok is None else ok) else np.inf

    def shortest(self, unit: str) -> list[str]:
        """The arcs of the shortest path through the machine composed with a unit."""
        return self.free_path(unit) if self.bpe else self.lightest_path(unit)

    def lightest_path(self, unit: str) -> list[str]:
        """The shortest path for any weights: sums along paths, the least of the paths to a position.

        Of paths of one weight (the same pieces in another order) the one stays whose last arc begins first."""
        n, inf = len(unit), np.inf
        least, last = [inf] * (n + 1), [None] * (n + 1)
        least[0] = 0.0
        for i in range(n):
            if (so_far := least[i]) == inf:
                continue
            for arc in self.arcs(unit, i):
                if (w := so_far + self.weight(last[i], arc)) < least[to := i + len(arc)]:
                    least[to], last[to] = w, arc
        path = []
        while n:
            path.append(last[n])
            n -= len(last[n])
        return path[::-1]

    def free_path(self, unit: str) -> list[str]:
        """The shortest path where weights are 0 or infinite, which is the first one found of weight 0.

        Uniform-cost search: of the open states, all of weight 0, the latest is gone on from, by its longest arc of weight 0,
        and the machine is composed only as far as that leads. A position has one state of finite weight, so a position
        that was left for want of such an arc is never entered again."""
        n, follows = len(unit), self.follows
        path, at, choices, dead = [], [0], [self.arcs(unit, 0)], set()
        while at[-1] < n:
            if not choices[-1]:
                dead.add(at.pop())
                choices.pop()
                path.pop()
                continue
            arc = choices[-1].pop()
            end = at[-1] + len(arc)
            if end in dead:
                continue
            if path:
                free = follows.get((path[-1], arc))
                if not (self.weight(path[-1], arc) == 0 if free is None else free):
                    continue
            path.append(arc)
            at.append(end)
            if end < n:
                choices.append(self.arcs(unit, end))
        return path

    def write(self, unit: str) -> bytes:
        """The ids of a unit, four bytes each."""
        arcs, code = [unit] if unit in self.users else self.shortest(unit), self.code
        try:
            return b"".join([code[arc] for arc in arcs])
        except KeyError:
            return self.write_unknown(arcs)

    def write_unknown(self, arcs: list[str]) -> bytes:
        ids: list[int] = []
        for arc in arcs:
            if (i := self.ids.get(arc)) is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in arc.encode("utf-8", "replace")]
            else:
                ids.append(self.unk)
        return np.array(ids, dtype=np.int32).tobytes()

    def recall(self, unit: str) -> bytes:
        """The ids of a unit, remembered."""
        if (ids := self.known.get(unit)) is None:
            if (ids := self.older.get(unit)) is None:
                ids = self.write(unit)
            if len(unit) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                if len(self.follows) >= FOLLOWS:
                    self.follows.clear()
                self.known[unit] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not (text := self.normalise(text)):
            return np.zeros(0, dtype=np.int32)
        units = self.units(text) if self.frozen is None else [u for part in self.frozen(text) for u in ([part] if part in self.users else self.units(part))]
        parts = list(map(self.known.get, units))
        if None in parts:
            parts = [self.recall(u) if ids is None else ids for u, ids in zip(units, parts, strict=True)]
        ids = np.frombuffer(b"".join(parts), dtype=np.int32)
        if not self.bytes:  # unknown characters side by side are one
            ids = ids[np.append(True, (ids[1:] != self.unk) | (ids[:-1] != self.unk))]
        return ids

    def decode(self, ids) -> str | None:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD. None if an id is null or outside the vocabulary."""
        ids = ids.tolist() if hasattr(ids, "tolist") else list(ids)
        if None in ids or ids and not 0 <= min(ids) <= max(ids) < len(self.out):
            return None
        return self.read(ids)

    def read(self, ids: list[int]) -> str:
        """The text of ids of the vocabulary."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        norm = self.normalise
        if norm.dummy and norm.suffix:
            return text.removesuffix(" ")
        if norm.dummy or norm.squeeze:
            # A space goes from the first piece; with extra spaces removed, also from those after it while nothing else was read.
            for i in ids:
                if self.out[i] and (i == self.unk or self.out[i][:1] != b" " or i in self.byte_ids):
                    break
                if self.out[i]:
                    text = text[1:]
                    if not norm.squeeze or len(self.out[i]) > 1:
                        break
        return text


@lru_cache(2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def load(spark: SparkSession, path: str) -> bytes:
    """A model's bytes. The driver reads it, by Spark if the path names a store; the workers get it with the task."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def tokenize(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded_equal for each row of docs.

    ids are those of the whole text; decoded_equal tells whether they decode to it again. With a model that rewrites
    nothing that fails only for texts that hold U+2581 (it stands for a space). Null and empty texts have no ids and are equal (null: as empty). Rows that
    repeat are encoded alike, empty tables stay empty, other columns are not looked at."""
    model = load(docs.sparkSession, model_path)

    def run(batches):
        t = transducer(model)
        for batch in batches:
            encoded, equal = [], []
            for text in batch.column(1).to_pylist():
                encoded.append(ids := t.encode(text or ""))
                equal.append(t.read(ids.tolist()) == (text or ""))
            sizes = np.array([len(x) for x in encoded], dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(encoded) if encoded else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids, pa.array(equal, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded_equal"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(trimmed(run, docs.sparkSession), f"doc_id {kind}, n_tokens int, ids array<int>, decoded_equal boolean")


def decode_ids(tokens: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of ids.

    The text is null for null ids, and where one of the ids is null or outside the vocabulary (below 0 or too large); no
    ids give an empty text. Empty tables stay empty, rows that repeat are decoded alike."""
    model = load(tokens.sparkSession, model_path)

    def run(batches):
        t = transducer(model)
        for batch in batches:
            texts = [None if ids is None else t.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(trimmed(run, tokens.sparkSession), f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's whole text."""
    return tokenize(docs)
