"""Conversation repair: role and fault sequences compressed by pair replacement, one min-plus matrix of edits per rule."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import BLANK, text_of, written

# Fixed values of the edit model.
RETYPE, DELETE, INSERT, RAGGED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Role initial that a state accepts next, and the state behind it: start, behind a system, user and assistant row.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ("user", "user", "assistant", "user")  # the role that a new or changed row gets in a state
ACCEPTING = (0, 3)
STATES = range(4)

SEGMENT = 1024  # rows of a conversation whose edits are found in one piece
RULES = 512  # rules of the grammar at most; the rest of a sequence stays as it is
ROUNDS = 12
NONE = " "  # what a null becomes


class Rope:
    """A string kept as two halves, so that rules share their parts; compared by its letters."""

    __slots__ = ("left", "right", "leaf")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, leaf: str = ""):
        self.left, self.right, self.leaf = left, right, leaf

    def __add__(self, other: Rope) -> Rope:
        if not self.left and not self.leaf:
            return other
        return self if not other.left and not other.leaf else Rope(self, other)

    def letters(self) -> Iterator[str]:
        stack = [self]
        while stack:
            top = stack.pop()
            if top.left:
                stack += [top.right, top.left]
            else:
                yield from top.leaf

    def __lt__(self, other: Rope) -> bool:
        if self is other:
            return False
        a, b = self, other
        while a.left and b.left and a.left is b.left:
            a, b = a.right, b.right
        for x, y in zip(a.letters(), b.letters()):
            if x != y:
                return x < y
        return False  # of two strings of equal cost none begins with the other

    def __str__(self) -> str:
        return "".join(self.letters())


Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def better(a: Cell, b: Cell) -> Cell:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def times(rows: Matrix, m: Matrix) -> Matrix:
    """Min-plus product: the cheapest way over a middle state, ties by the letters of the edits."""
    out = []
    for row in rows:
        line: list[Cell] = [None] * 4
        for s in STATES:
            if row[s] is None:
                continue
            for t in STATES:
                if m[s][t] is not None:
                    line[t] = better(line[t], (row[s][0] + m[s][t][0], row[s][1] + m[s][t][1]))
        out.append(line)
    return out


def insertions() -> Matrix:
    """Inserted rows alone: the fewest that lead from one state to another."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for s in STATES:
        at, n = s, 0
        while out[s][at] is None:
            out[s][at] = (INSERT * n, Rope(leaf="I" * n))
            at, n = NEXT[at][GIVEN[at][0]], n + 1
    return out


def edit(symbol: str) -> Matrix:
    """One row, with insertions before it. A symbol is a role initial (or `x`), upper case where ragged; `D` must go."""
    role, ragged = symbol.lower(), symbol.isupper()
    own: Matrix = [[None] * 4 for _ in STATES]
    for s in STATES:
        own[s][s] = (DELETE, Rope(leaf="D"))
        if symbol == "D":
            continue
        extra = RAGGED if ragged else 0
        changed = NEXT[s][GIVEN[s][0]]
        own[s][changed] = better(own[s][changed], (RETYPE + extra, Rope(leaf="R")))
        if role in NEXT[s]:
            own[s][NEXT[s][role]] = better(own[s][NEXT[s][role]], (extra, Rope(leaf="K")))
    return times(insertions(), own)


#: Letters of a sequence before compression; rules get the numbers behind them.
LETTERS = "suaxSUAXD"


class Grammar:
    """Rules (left, right) in order; symbol len(LETTERS) + r stands for rule r. Matrices are made once, bottom up."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules = rules
        self.matrices = [edit(c) for c in LETTERS]
        for left, right in rules:
            self.matrices.append(times(self.matrices[left], self.matrices[right]))

    def best(self, symbols: list[int]) -> Matrix:
        """Matrix of a sequence."""
        made: Matrix = [[(0, Rope()) if s == t else None for t in STATES] for s in STATES]
        for x in symbols:
            made = times(made, self.matrices[x])
        return made


def finished(row: list[Cell]) -> Cell:
    last = times([row], insertions())[0]
    return better(last[0], last[3])


def replaced(symbols: list[int], rules: list[tuple[int, int]], since: int) -> list[int]:
    """The sequence with each rule from number `since` on applied from left to right, several rules in one pass."""
    named = {pair: len(LETTERS) + since + n for n, pair in enumerate(rules[since:])}
    out, i = [], 0
    while i < len(symbols):
        name = named.get((symbols[i], symbols[i + 1])) if i + 1 < len(symbols) else None
        out.append(symbols[i] if name is None else name)
        i += 1 if name is None else 2
    return out


def compressed(word: str, rules: list[tuple[int, int]], ends: list[int]) -> list[int]:
    """A sequence under the rules of all rounds; `ends` are the numbers of rules after each round."""
    symbols = [LETTERS.index(c) for c in word]
    for k, end in enumerate(ends):
        if len(symbols) < 2:
            break
        symbols = replaced(symbols, rules[:end], ends[k - 1] if k else 0)
    return symbols


def grammar_of(words: DataFrame, most: int = RULES, rounds: int = ROUNDS) -> tuple[list[tuple[int, int]], list[int]]:
    """Pair replacement over all sequences (word, n): each round counts neighbours everywhere and names the frequent pairs.

    A round takes pairs from the most frequent down whose left and right symbols do not meet as right and left of one taken
    before, so that they cannot overlap. Only the counts of the most frequent pairs reach the driver.
    """
    rules: list[tuple[int, int]] = []
    ends: list[int] = []
    while len(ends) < rounds and len(rules) < most:
        def pairs(batches, rules=tuple(rules), ends=tuple(ends)):
            seen: dict[tuple[int, int], int] = {}

            def out():
                rows = [(a, b, n) for (a, b), n in seen.items()]
                return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate("abn")})

            for batch in batches:
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                    symbols, i = compressed(word, list(rules), list(ends)), 0
                    while i + 1 < len(symbols):
                        pair = symbols[i], symbols[i + 1]
                        seen[pair] = seen.get(pair, 0) + n
                        # a run of one symbol holds half as many pairs
                        i += 2 if symbols[i] == symbols[i + 1] and symbols[i + 2:i + 3] == symbols[i:i + 1] else 1
                if len(seen) > 1 << 16:
                    yield out()
                    seen.clear()
            yield out()

        counted = words.mapInArrow(pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        taken, lefts, rights = [], set(), set()
        for r in counted.orderBy(F.desc("n"), "a", "b").limit(most).collect():
            if r["a"] in rights or r["b"] in lefts or (r["a"] == r["b"] and (r["a"] in lefts or r["b"] in rights)):
                continue
            taken.append((r["a"], r["b"]))
            lefts.add(r["a"])
            rights.add(r["b"])
        taken = taken[:most - len(rules)]
        if not taken:
            break
        rules += taken
        ends.append(len(rules))
    return rules, ends


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text, copies) with faults made by the crc32 of conversation and turn; nulls are one space."""
    said = rows.select(keyed("conv_id"), F.col("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("role", "text")])
    what = F.pmod(F.crc32(F.concat_ws(":", "key", F.coalesce(F.col("turn").cast("string"), F.lit(NONE))).cast("binary")), F.lit(20))
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = said.select("key", "turn", F.when(what == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(what == 3, 2).when(what == 0, 0).otherwise(1).alias("copies"))
    return made.where("copies > 0")


def keyed(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NONE)).alias("key")


def undamaged(rows: DataFrame) -> DataFrame:
    return rows.select(keyed("conv_id"), F.col("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


ORDER = ("key", "known", "turn", "role", "said")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("known", F.col("turn").isNotNull()).withColumn("said", F.md5(F.col("text").cast("binary")))


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, their symbol and whether their role and text were said before; texts stay behind."""
    last = F.regexp_extract("text", rf"([^{BLANK}])[{BLANK}]*+\z", 1)
    slim = ordered(rows).select("key", "known", "turn", "role", "said", "copies", last.alias("last"))
    once = slim.groupBy("key", "known", "turn", "role", "said", "last").agg(F.sum("copies").alias("n"))
    first = once.groupBy(F.col("key").alias("k"), F.col("role").alias("r"), F.col("said").alias("s")).agg(F.min(F.struct("known", "turn")).alias("first"))
    met = once.join(first, (F.col("key") == F.col("k")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    later = ~F.struct("known", "turn").eqNullSafe(F.col("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("last") == "", "b").when(later, "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("")
    return met.select("key", "known", "turn", "role", "said", "n", initial.alias("initial"), fault.alias("fault"))


def segmented(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The rows in order as segments of at most `most`, dealt over all tasks by range, so that one conversation may span many."""
    def work(batches):
        from pyspark import TaskContext
        part, serial, state = TaskContext.get().partitionId(), 0, None
        done = []

        def closed():
            nonlocal serial
            serial += 1
            word, blank, dup, ragged, illegal, low, high, turns = state["word"], *[state[c] for c in ("b", "d", "t", "illegal", "low", "high", "turns")]
            return {"key": state["key"], "part": part, "serial": serial, "word": "".join(word), "blank": blank, "duplicate": dup, "truncated": ragged,
                    "illegal": illegal, "first": state["first"], "last": state["last"], "low": low, "high": high, "turns": turns}

        for batch in batches:
            for key, turn, initial, fault, n in zip(*[batch.column(c).to_pylist() for c in ("key", "turn", "initial", "fault", "n")]):
                for copy in range(n):
                    if state is not None and (state["key"] != key or len(state["word"]) >= most):
                        done.append(closed())
                        state = None
                    # the second copy of a row repeats it; a blank one is blank again
                    now = "d" if copy and fault != "b" else fault
                    if state is None:
                        state = {"key": key, "word": [], "b": 0, "d": 0, "t": 0, "illegal": 0, "first": initial, "last": initial, "low": turn, "high": turn,
                                 "turns": 0 if turn is None else 1}
                    else:
                        state["illegal"] += state["last"] + initial not in LEGAL
                        if turn is not None and turn != state["high"]:
                            state["turns"] += 1
                            state["low"] = turn if state["low"] is None else state["low"]
                            state["high"] = turn
                        state["last"] = initial
                    if now:
                        state[now] += 1
                    letter = initial if initial in ("s", "u", "a") else "x"
                    state["word"].append("D" if now in ("b", "d") else letter.upper() if now == "t" else letter)
            if done:
                yield pa.RecordBatch.from_pylist(done, SEGMENTS)
                done.clear()
        if state is not None:
            done.append(closed())
        if done:
            yield pa.RecordBatch.from_pylist(done, SEGMENTS)

    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    kinds = "key string, part int, serial int, word string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
    return dealt.select("key", "turn", "initial", "fault", F.col("n").cast("long").alias("n")).mapInArrow(work, kinds)


SEGMENTS = pa.schema([("key", pa.string()), ("part", pa.int32()), ("serial", pa.int32()), ("word", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
                      ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("low", "high", "turns")]])
TOTALS = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(segments: DataFrame, rules: list[tuple[int, int]], ends: list[int]) -> DataFrame:
    """One row per segment with its matrix of cheapest edits, as lists over (from, to) states."""
    def work(batches):
        grammar, known = Grammar(rules), {}
        for batch in batches:
            costs, audits = [], []
            for word in batch.column("word").to_pylist():
                if word not in known:
                    if len(known) >= 4096:
                        known.clear()
                    m = grammar.best(compressed(word, rules, ends))
                    known[word] = [c[0] if c else None for row in m for c in row], [str(c[1]) if c else None for row in m for c in row]
                costs.append(known[word][0])
                audits.append(known[word][1])
            arrays = [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "costs", "audits"])

    kinds = ", ".join(f"{c} {t}" for c, t in segments.dtypes)
    return segments.mapInArrow(work, f"{kinds}, costs array<bigint>, audits array<string>")


def folded(parts: DataFrame) -> DataFrame:
    """Per conversation the product of its segments in order, read as a stream: a task holds one segment and the answer so far."""
    def work(batches):
        state, done = None, []

        def closed():
            cost, audit = finished(state["row"])
            gaps = min(state["high"] - state["low"] + 1 - state["turns"], 2 ** 63 - 1) if state["turns"] else 0
            return {"key": state["key"], "gaps": gaps, **{c: state[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": str(audit)}

        for batch in batches:
            for r in batch.to_pylist():
                cells = [None if c is None else (c, Rope(leaf=a)) for c, a in zip(r["costs"], r["audits"])]
                m = [cells[4 * s:4 * s + 4] for s in STATES]
                if state is None or state["key"] != r["key"]:
                    if state is not None:
                        done.append(closed())
                    state = {**r, "row": m[0]}
                    continue
                state["row"] = times([state["row"]], m)[0]
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    state[c] += r[c]
                state["illegal"] += state["last"] + r["first"] not in LEGAL
                state["last"] = r["last"]
                if r["low"] is not None:
                    state["turns"] += r["turns"] - (r["low"] == state["high"])
                    state["low"] = r["low"] if state["low"] is None else state["low"]
                    state["high"] = r["high"]
            if done:
                yield pa.RecordBatch.from_pylist(done, made)
                done.clear()
        if state is not None:
            done.append(closed())
        if done:
            yield pa.RecordBatch.from_pylist(done, made)

    made = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
    return parts.repartition("key").sortWithinPartitions("key", "part", "serial").mapInArrow(work, TOTALS)


def told(rows: DataFrame, audits: DataFrame, whole: bool) -> DataFrame:
    """The audits with digests of the repaired rows: each audit stands before its conversation's rows in a sorted stream."""
    numbers = [c for c, t in audits.dtypes if t == "bigint"]
    texts = ordered(rows).select("key", F.lit(1).alias("kind"), "known", "turn", "role", "said", "text", "copies", F.lit(None).cast("string").alias("audit"),
                                 *[F.lit(None).cast("bigint").alias(c) for c in numbers])
    heads = audits.select("key", F.lit(0).alias("kind"), F.lit(None).cast("boolean").alias("known"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("said"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), "audit", *numbers)
    stream = texts.withColumn("turn", F.col("turn").cast("bigint")).unionByName(heads).repartition("key").sortWithinPartitions("key", "kind", "known", "turn", "role", "said")
    made = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in numbers], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.list_(pa.string()))])

    def work(batches):
        head, done = None, []

        def put(role, text):
            line = f"{role}:{text}"
            head["sum"].update((("\n" if head["n"] else "") + line).encode())
            head["n"] += 1
            if whole:
                head["lines"].append(line)

        def inserts():
            while head["audit"].startswith("I", head["at"]):
                put(GIVEN[head["state"]], "")
                head["state"] = NEXT[head["state"]][GIVEN[head["state"]][0]]
                head["at"] += 1

        def row(role, text):
            inserts()
            what = head["audit"][head["at"]]
            head["at"] += 1
            if what == "D":
                return
            role = role if what == "K" else GIVEN[head["state"]]
            put(role, text)
            head["state"] = NEXT[head["state"]][role[:1]]

        def closed():
            inserts()
            return {"key": head["key"], **{c: head[c] for c in numbers}, "audit": head["audit"], "repaired_sha256": head["sum"].hexdigest(), "repaired": head["lines"] if whole else None}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "kind", "role", "text", "copies", "audit", *numbers)]
            for key, kind, role, text, copies, audit, *counts in zip(*columns):
                if kind == 0:
                    if head is not None:
                        done.append(closed())
                    head = {"key": key, "audit": audit, "at": 0, "state": 0, "n": 0, "sum": hashlib.sha256(), "lines": [], **dict(zip(numbers, counts))}
                else:
                    for _ in range(copies):
                        row(role, text)
            if done:
                yield pa.RecordBatch.from_pylist(done, made)
                done.clear()
        if head is not None:
            done.append(closed())
        if done:
            yield pa.RecordBatch.from_pylist(done, made)

    return stream.mapInArrow(work, ", ".join(["key string", *[f"{c} bigint" for c in numbers], "audit string", "repaired_sha256 string", "repaired array<string>"]))


def repair(conversations: DataFrame, damage: bool = False, whole: bool = False, segment: int = SEGMENT, rules: int = RULES) -> DataFrame:
    """One row per conversation of `conversations` (conv_id, turn, role, text): its faults and the cheapest edits that mend it.

    Rows go by turn (null first, ties by role, then by digest of the text). The first fault of a row counts: blank,
    duplicate (role and text seen earlier), truncated (last character that is not blank is none of `.!?`). Keep costs 0,
    Rerole 2, Delete 3 (blank and duplicate rows must go), Insert 2, a truncated row that stays 1 more; the rows left have
    role initials `(s?(ua)+)?`. `audit` has the initials of the cheapest edits, of ties the least; `repaired_sha256` digests
    the repaired `role:text` lines, `whole` adds the lines. `damage` first makes faults by the ids.

    Null conversation is a conversation of its own, null role or text is one space, null turns count for no gap. A role
    without a first letter s, u or a fits nowhere and is changed or deleted. Conversations without a row have zeros and
    empty digests. An empty table gives no rows; other columns are not read.

    A conversation of any length is cut into segments that are solved apart. Sequences are compressed by rules found over
    all segments; every rule has one matrix from state to state, made bottom up and used by all conversations. Only the last
    fold and the digest of one conversation's text, which is sequential, read it as a stream in one task.
    """
    rows = damaged(conversations) if damage else undamaged(conversations)
    segments = written(segmented(marked(rows), segment))
    grammar, ends = grammar_of(segments.groupBy("word").agg(F.count(F.lit(1)).alias("n")), rules)
    audits = folded(solved(segments, grammar, ends))
    made = told(rows, audits, whole)
    every = conversations.select("conv_id", keyed("conv_id")).distinct()
    full = every.join(made, "key", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    columns = ["conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
               F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return full.select(*columns, *([F.coalesce("repaired", F.array().cast("array<string>")).alias("repaired")] if whole else []))
