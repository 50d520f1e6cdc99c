"""Repair of the role structure of conversations by cheapest edits.

The roles of a repaired conversation have the initials ``(s?(ua)+)?``.  Edits: Keep (0), Rerole to the user or
assistant that may come next (2), Delete (3; blank and duplicate rows must go), Insert an empty user or assistant
(2); an undeleted truncated row adds 1.  The audit is the string of the initials of the cheapest edits in order,
the ASCII-least of equally cheap ones.

Dynamic program over rows and four states (nothing yet, after system, user, assistant).  The edits up to a state
are a linked node (last edit, node before), so states share their prefixes; every node has ancestors 1, 2, 4,
... edits back and a rolling hash of its string.  Two equally cheap ways into a state are compared at their longest
common prefix, found by going back in halving steps while the hashes differ; that the two prefixes are one and the
same node is verified, and if they are not (a collision) the strings are compared edit by edit.  The conversations of
a batch go through the program in step, row by row, in NumPy.

Shape on a cluster: rows without their texts (a digest of role and text, three flags) are range-partitioned and sorted
by conversation and turn, so a long conversation spans many tasks.  A block of at most ``BLOCK`` rows is solved for
each state it may begin in: cost, audit and ASCII order of the audits for each state it may end in.  Audits of the same
rows that end in a row's edit never begin one another, so blocks are chained by costs and orders alone.  Equal rows
of one turn travel as one row with a count; duplicates are found by an aggregate over digests.  Texts are shuffled
once, with the audits, for the repaired rows, which are streamed.  What a conversation's result holds whole by
its definition passes one task: the audit string, and the digest, which is a chain over the repaired text.

Edge cases: null roles and texts are one space; a null ``conv_id`` is a conversation of its own; null turns come
first; rows of one turn with different content follow the order of their digests; equal rows stand side by side,
so all but the first are duplicates; empty tables give empty results.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanalign.session import written

#: Rows of a block, and rows that go through the program in step.
BLOCK, STEP = 4096, 1 << 15
#: Modulus of the rolling hashes.
PRIME, BASE = (1 << 31) - 1, 1_000_003
START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = {USER: "user", ASSISTANT: "assistant"}
#: State after the user or assistant that may come next.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_FAR = np.int64(1) << 60
_SPACES = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """Drop, empty, cut, repeat or re-role rows as the checksum of ``conv_id:turn`` says (nulls: one space)."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), way.alias("way"))
    return rows.where("way <> 0").select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _digest() -> Column:
    """Tells apart conversations, roles and texts."""
    conv = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))
    parts = [F.length(conv), F.lit(":"), conv, F.length("role"), F.lit(":"), F.col("role"), F.col("text")]
    return F.substring(F.unhex(F.sha2(F.concat(*[p.cast("string") for p in parts]), 256)), 1, 16)


def _read(rows: DataFrame) -> DataFrame:
    said = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    return rows.withColumn("digest", _digest())


def faults(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id, turn, digest``: ``copies``, role ``initial``, and whether the first copy is
    ``blank``, ``duplicate`` or ``truncated`` (the first of these that holds)."""
    flags = _read(rows).select(
        "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{_SPACES}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{_SPACES}]*+\z")).alias("cut"))
    once = flags.groupBy("conv_id", "turn", "digest", "initial", "blank", "cut").agg(F.count("*").alias("copies"))
    once = once.withColumn("when", F.struct(F.col("turn").isNotNull().alias("told"), "turn"))
    # most digests occur in one turn only and need no join partner
    first = once.groupBy(F.col("digest").alias("same")).agg(F.min("when").alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    joined = once.join(first, once["digest"] == first["same"], "left")
    again = F.coalesce(F.col("when") > F.col("first"), F.lit(False))
    return joined.select("conv_id", "turn", "digest", "initial", "copies", "blank", (again & ~F.col("blank")).alias("duplicate"),
                         (F.col("cut") & ~again & ~F.col("blank")).alias("truncated"))


class Nodes:
    """Strings of edits as linked nodes with ancestors in powers of two and rolling hashes."""

    def __init__(self, room: int = 1 << 12, prime: int = PRIME) -> None:
        self.prime, self.size = prime, 1  # node 0 is the empty string
        self.edit, self.depth, self.hash = np.zeros(room, np.uint8), np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.up = [np.zeros(room, np.int64)]

    def add(self, parents: np.ndarray, edits: np.ndarray) -> np.ndarray:
        """A node for each parent and edit."""
        new = np.arange(self.size, self.size + len(parents))
        self.size += len(parents)
        if self.size > len(self.edit):
            room = max(self.size, 2 * len(self.edit))
            grown = lambda x: np.concatenate([x, np.zeros(room - len(x), x.dtype)])
            self.edit, self.depth, self.hash, self.up = grown(self.edit), grown(self.depth), grown(self.hash), [grown(u) for u in self.up]
        self.edit[new], self.depth[new] = edits, self.depth[parents] + 1
        self.hash[new] = (self.hash[parents] * BASE + edits) % self.prime
        while len(new) and (1 << len(self.up)) <= self.depth[new].max():
            self.up.append(np.zeros(len(self.edit), np.int64))
        self.up[0][new] = parents
        for k in range(1, len(self.up)):
            self.up[k][new] = self.up[k - 1][self.up[k - 1][new]]
        return new

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the string of each ``a`` is ASCII-less than that of ``b`` (a beginning is less)."""
        x, y = a.copy(), b.copy()
        for k in reversed(range(len(self.up))):
            for own, other in ((x, y), (y, x)):
                back = np.flatnonzero(self.depth[own] - self.depth[other] >= 1 << k)
                own[back] = self.up[k][own[back]]
        differ = self.hash[x] != self.hash[y]
        for k in reversed(range(len(self.up))):
            ux, uy = self.up[k][x], self.up[k][y]
            back = differ & (self.hash[ux] != self.hash[uy])
            x, y = np.where(back, ux, x), np.where(back, uy, y)
        result = np.where(differ, self.edit[x] < self.edit[y], self.depth[a] < self.depth[b])
        # equal hashes must mean one and the same node
        wrong = np.where(differ, self.up[0][x] != self.up[0][y], x != y)
        for k in np.flatnonzero(wrong).tolist():
            result[k] = self.string(int(a[k])) < self.string(int(b[k]))
        return result

    def string(self, node: int) -> bytes:
        out = bytearray()
        while node:
            out.append(self.edit[node])
            node = int(self.up[0][node])
        return bytes(reversed(out))

    def strings(self, nodes: np.ndarray) -> list[bytes]:
        """The strings of many nodes, read back in step."""
        depth = self.depth[nodes]
        ends = np.cumsum(depth)
        flat, at, node, place = np.zeros(int(depth.sum()), np.uint8), np.arange(len(nodes)), nodes.copy(), ends - 1
        while True:
            at = at[node[at] > 0]
            if not len(at):
                break
            flat[place[at]] = self.edit[node[at]]
            place[at] -= 1
            node[at] = self.up[0][node[at]]
        whole = flat.tobytes()
        return [whole[e - d:e] for e, d in zip(ends.tolist(), depth.tolist())]


_K, _R, _D, _I = (np.uint8(ord(c)) for c in "KRDI")


def solve(starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray, initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, prime: int = PRIME):
    """Cheapest edits of each lane: rows ``starts`` to ``starts + sizes``, begun in state ``entry``.

    Returns for each lane and end state the cost, the place of the audit in ASCII order, and the audit.
    """
    lanes, nodes = len(starts), Nodes(prime=prime)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    cost = np.full((lanes, 4), _FAR)
    cost[np.arange(lanes), entry[order]] = 0
    node = np.zeros((lanes, 4), np.int64)
    for i in range(int(sizes[0]) if lanes else 0):
        n = int(np.searchsorted(-sizes, -i, "left"))  # lanes with more than i rows
        row = starts[:n] + i
        role, gone = initial[row], must_go[row]
        old, before = cost[:n].copy(), node[:n].copy()
        extra = np.where(truncated[row], TRUNCATED, 0)

        def reach(state: int, ways: list[tuple[int, np.ndarray, bool, np.ndarray]]) -> None:
            """Take the best way into a state: (from, cost, whether by an insert, last edit); the first of one origin wins ties."""
            best, source, insert, edit = ways[0][1].copy(), np.full(n, ways[0][0]), np.full(n, ways[0][2]), ways[0][3].copy()
            for origin, price, by_insert, last in ways[1:]:
                better = price < best
                tied = np.flatnonzero((price == best) & (best < _FAR) & (source != origin))
                if len(tied):
                    better[tied] = nodes.less(before[tied, origin], before[tied, source[tied]])
                best, source = np.where(better, price, best), np.where(better, origin, source)
                insert, edit = np.where(better, by_insert, insert), np.where(better, last, edit)
            there = np.flatnonzero(best < _FAR)
            parent = before[there, source[there]]
            inserted = insert[there].astype(bool)
            parent[inserted] = nodes.add(parent[inserted], np.full(int(inserted.sum()), _I))
            cost[:n, state] = best
            node[there, state] = nodes.add(parent, edit[there])

        def price(origin: int, more) -> np.ndarray:
            return np.minimum(old[:, origin] + more, _FAR)

        def into(state: int) -> tuple[np.ndarray, np.ndarray]:
            """Cost and edit that make a row the given state's role."""
            kept = role == state
            return np.where(gone, _FAR, np.where(kept, 0, REROLE) + extra), np.where(kept, _K, _R)

        deletes = np.full(n, _D)
        as_user, user_edit = into(USER)
        as_assistant, assistant_edit = into(ASSISTANT)
        reach(START, [(START, price(START, DELETE), False, deletes)])
        keeps = np.where(gone | (role != SYSTEM), _FAR, extra)
        reach(SYSTEM, [(SYSTEM, price(SYSTEM, DELETE), False, deletes), (START, price(START, keeps), False, np.full(n, _K))])
        reach(USER, [(USER, price(USER, DELETE), False, deletes), (USER, price(USER, as_user + INSERT), True, user_edit),
                     *((s, price(s, as_user), False, user_edit) for s in (START, SYSTEM, ASSISTANT))])
        reach(ASSISTANT, [(ASSISTANT, price(ASSISTANT, DELETE), False, deletes), (ASSISTANT, price(ASSISTANT, as_assistant + INSERT), True, assistant_edit),
                          (USER, price(USER, as_assistant), False, assistant_edit),
                          *((s, price(s, as_assistant + INSERT), True, assistant_edit) for s in (START, SYSTEM))])
    place = np.zeros((lanes, 4), np.int64)
    for a in range(4):
        for b in range(4):
            both = np.flatnonzero((cost[:, a] < _FAR) & (cost[:, b] < _FAR))
            if a != b and len(both):
                place[both, a] += nodes.less(node[both, b], node[both, a])
    audits = np.array(nodes.strings(node.reshape(-1)) + [None], object)[:-1].reshape(lanes, 4)
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    return cost[back], place[back], audits[back]


class _Conversation:
    """Blocks chained from the first to the last: per state the cost, the ASCII place and the linked audits."""

    def __init__(self) -> None:
        self.states = {START: (0, 0, None)}
        self.totals = dict.fromkeys(("n_rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last_initial = self.last_turn = self.least = self.most = None

    def add(self, block: dict) -> None:
        found = {}
        for way in block["ways"]:
            if way["entry"] in self.states:
                cost, place, audit = self.states[way["entry"]]
                own = (cost + way["cost"], place, way["place"], (audit, way["audit"]))
                # audits of different entries differ before this block, those of one entry within it
                if way["end"] not in found or own[:3] < found[way["end"]][:3]:
                    found[way["end"]] = own
        ranked = {key: k for k, key in enumerate(sorted(own[1:3] for own in found.values()))}
        self.states = {end: (own[0], ranked[own[1:3]], own[3]) for end, own in found.items()}
        t = self.totals
        for name in ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            t[name] += block[name]
        t["illegal"] += self.last_initial is not None and self.last_initial + block["first_initial"] not in ("su", "ua", "au")
        t["turns"] -= self.last_turn is not None and block["first_turn"] == self.last_turn
        self.last_initial, self.last_turn = block["last_initial"], block["last_turn"]
        self.least = block["least"] if self.least is None else self.least
        self.most = block["last_turn"] if block["last_turn"] is not None else self.most

    def row(self) -> dict:
        # a user may need its assistant, a system both
        ends = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
        cost, _, k, parts = min((own[0] + INSERT * ends[s], own[1], ends[s], own[2]) for s, own in self.states.items())
        audit = [b"I" * k]
        while parts:
            parts, own = parts
            audit.append(own)
        t = dict(self.totals)
        turns = t.pop("turns")
        gaps = 0 if self.least is None else self.most - self.least + 1 - turns
        return {**t, "gaps": gaps, "cost": cost, "audit": b"".join(reversed(audit)).decode()}


_TOTALS = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BLOCK_FIELDS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns", "least", "first_turn", "last_turn")
_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("audit", pa.binary())]))
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Block:
    """Neighbouring rows of one conversation; ``sure`` if they surely are its first ones."""

    def __init__(self, first: dict, sure: bool) -> None:
        self.first, self.sure, self.rows, self.size = first, sure, [], 0

    def summary(self) -> dict:
        turns = [r["turn"] for r in self.rows if r["turn"] is not None]
        letters = [r["initial"] for r in self.rows]
        # copies of a row follow each other and have one initial, which may not follow itself
        illegal = sum(p not in _LEGAL for p in zip(letters, letters[1:])) + sum(r["copies"] - 1 for r in self.rows)
        return {"n_rows": self.size, "blank": sum(r["copies"] for r in self.rows if r["blank"]),
                "duplicate": sum(r["copies"] - (r["first"] and not r["duplicate"]) for r in self.rows if not r["blank"]),
                "truncated": sum(r["truncated"] and r["first"] for r in self.rows), "illegal": illegal,
                "turns": len(set(turns)), "least": min(turns, default=None), "first_turn": self.rows[0]["turn"], "last_turn": self.rows[-1]["turn"]}


def _solved(blocks: list[_Block], prime: int) -> dict[str, pa.Array]:
    rows = [r for b in blocks for r in b.rows]
    copies = np.array([r["copies"] for r in rows])
    at = np.repeat(np.arange(len(rows)), copies)
    first = np.zeros(len(at), bool)
    first[np.cumsum(copies) - copies] = [r["first"] for r in rows]
    flag = lambda name: np.array([r[name] for r in rows])[at]
    initial = np.array([_INITIALS.get(r["initial"], START) for r in rows])[at]
    sizes = np.array([b.size for b in blocks])
    entries = [[START] if b.sure else [START, SYSTEM, USER, ASSISTANT] for b in blocks]
    of_lane = np.repeat(np.arange(len(blocks)), [len(e) for e in entries])
    entry = np.array([e for own in entries for e in own])
    cost, place, audits = solve((np.cumsum(sizes) - sizes)[of_lane], sizes[of_lane], entry, initial,
                                flag("blank") | flag("duplicate") | ~first, flag("truncated") & first, prime)
    ways: list[list[dict]] = [[] for _ in blocks]
    for lane, b in enumerate(of_lane.tolist()):
        ways[b] += [{"entry": int(entry[lane]), "end": s, "cost": int(cost[lane, s]), "place": int(place[lane, s]), "audit": audits[lane, s]}
                    for s in range(4) if cost[lane, s] < _FAR]
    found = [b.summary() for b in blocks]
    return {"turn": pa.array([b.first["turn"] for b in blocks], pa.int64()), "digest": pa.array([b.first["digest"] for b in blocks], pa.binary()),
            "part": pa.array([b.first["part"] for b in blocks], pa.int64()), **{n: pa.array([f[n] for f in found], pa.int64()) for n in _BLOCK_FIELDS},
            "first_initial": pa.array([b.rows[0]["initial"] for b in blocks], pa.string()),
            "last_initial": pa.array([b.rows[-1]["initial"] for b in blocks], pa.string()), "ways": pa.array(ways, _WAYS)}


def solved_blocks(flagged: DataFrame, block: int = BLOCK, prime: int = PRIME) -> DataFrame:
    """Blocks of each conversation's rows, solved for each state they may begin in."""
    conv = flagged.schema["conv_id"].dataType
    schema = (f"conv_id {conv.simpleString()}, turn long, digest binary, part long, " + ", ".join(f"{n} long" for n in _BLOCK_FIELDS)
              + ", first_initial string, last_initial string, ways array<struct<entry:int,end:int,cost:long,place:int,audit:binary>>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[_Block] = []
        begun, waiting = False, 0
        for batch in batches:
            conv_type = batch.column(0).type
            for r in batch.to_pylist():
                new = not blocks or r["conv_id"] != blocks[-1].first["conv_id"]
                if new or blocks[-1].size + r["copies"] > block:
                    if waiting > STEP:
                        yield answer(blocks, conv_type)
                        blocks, waiting = [], 0
                    # the first conversation of a task may have begun in the task before
                    blocks.append(_Block(r, new and begun))
                    begun = True
                blocks[-1].rows.append(r)
                blocks[-1].size += r["copies"]
                waiting += r["copies"]
        if blocks:
            yield answer(blocks, conv_type)

    def answer(blocks: list[_Block], conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch({"conv_id": pa.array([b.first["conv_id"] for b in blocks], conv_type), **_solved(blocks, prime)})

    # a row that occurs very often goes in several parts, so that no block is larger than its bound
    parts = flagged.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {block}"))))
    parts = parts.withColumn("first", F.col("part") == 0).withColumn("copies", F.least(F.lit(block).cast("long"), F.col("copies") - F.col("part") * block))
    keys = ["conv_id", "turn", "digest", "part"]
    return parts.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema)


def audits(rows: DataFrame, block: int = BLOCK, prime: int = PRIME) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text``): ``n_rows``, ``gaps`` in the turns, counts of
    ``blank``, ``duplicate``, ``truncated`` rows and ``illegal`` neighbours, the ``cost`` of the cheapest edits and their ``audit``."""
    blocks = solved_blocks(written(faults(rows), "faults"), block, prime)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in _TOTALS) + ", audit string"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, current = None, None
        for batch in batches:
            done, ids = [], []
            for r in batch.to_pylist():
                if current is None or r["conv_id"] != conv:
                    if current is not None:
                        done.append(current.row())
                        ids.append(conv)
                    conv, current = r["conv_id"], _Conversation()
                current.add(r)
            yield told(done, ids, batch.column(0).type)
        if current is not None:
            yield told([current.row()], [conv], batch.column(0).type)

    def told(done: list[dict], ids: list, conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch({"conv_id": pa.array(ids, conv_type), **{n: pa.array([d[n] for d in done], pa.int64()) for n in _TOTALS},
                                "audit": pa.array([d["audit"] for d in done], pa.string())})

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "part").mapInArrow(chain, schema)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows that are left of each conversation: ``conv_id, place`` (from 0), ``edit`` (K, R or I), ``role, text``.

    All rows of a conversation are in one partition, in order.
    """
    spark_type = rows.schema["conv_id"].dataType.simpleString()
    lines = _read(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    plans = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"),
                           F.lit("").alias("role"), F.col("audit").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, tail, at, state, place = None, "", 0, 0, START, 0
        for batch in batches:
            out: list[tuple] = []

            def inserts() -> None:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    state = NEXT[state]
                    out.append((conv, place, "I", INSERTED[state], ""))
                    at, place = at + 1, place + 1

            for own, kind, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5))):
                if kind == 0:
                    conv, audit, tail, at, state, place = own, text, len(text.rstrip("I")), 0, START, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[state]
                    out.append((conv, place, edit, INSERTED[state] if edit == "R" else role, text))
                    place += 1
                if at == tail:
                    inserts()  # behind the last row
            names = ("conv_id", "place", "edit", "role", "text")
            types = (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(zip(names, types))})

    stream = plans.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    return stream.mapInArrow(apply, f"conv_id {spark_type}, place long, edit string, role string, text string")


def digests(lines: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the lines ``role:text``, newline-joined, of ``repaired``, in their partitions and order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for own, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if digest is None or own != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.record_batch({"conv_id": pa.array([d[0] for d in done], batch.column(0).type), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})
        if digest is not None:
            yield pa.record_batch({"conv_id": pa.array([conv], batch.column(0).type), "repaired_sha256": pa.array([digest.hexdigest()], pa.string())})

    return lines.mapInArrow(scan, f"conv_id {lines.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: the columns of ``audits`` and ``repaired_sha256``.

    With ``damage`` the rows are damaged first; a conversation that loses all rows has zeros, an empty audit and
    the digest of nothing.
    """
    rows = damaged(conversations) if damage else conversations
    found = written(audits(rows), "audits")
    hashed = digests(repaired(rows, found)).withColumnRenamed("conv_id", "__conv")
    every = conversations.select(F.col("conv_id").alias("__id")).distinct()
    joined = every.join(found, F.col("__id").eqNullSafe(found["conv_id"]), "left").join(hashed, F.col("__id").eqNullSafe(F.col("__conv")), "left")
    return joined.select(F.col("__id").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in _TOTALS), F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
