"""A stack language over the library: numbers, tensors, models and mini-batches on one stack.

Scripts of the stack language run unchanged in meaning: a tensor is a DataFrame of (k, v), its values by linear NHWC
place, with a shape beside it; words on it build plans, and only what needs a number (a reduction, printing, a branch)
runs one. Words that took two tensors leave them below the result; their forms with ``=`` drop them.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import coo, linalg, losses
from gridloom.plans.model import Model
from gridloom.sources import corpora, summary

TRUE, FALSE = -1.0, 0.0


@dataclass
class Tensor:
    """shape is (n, h, w, c); rank 1 keeps its length in h, rank 2 in h and w."""

    df: DataFrame
    shape: tuple[int, int, int, int]
    rank: int

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def values(self) -> np.ndarray:
        out = np.zeros(self.size)
        for r in self.df.collect():
            out[r["k"]] = r["v"]
        return out

    def cells(self) -> DataFrame:
        """(i, j, v)."""
        w = self.shape[2]
        return self.df.select(F.expr(f"cast(k div {w} as int)").alias("i"), (F.col("k") % w).cast("int").alias("j"), "v")

    def map(self, f: Callable) -> Tensor:
        return Tensor(self.df.select("k", f(F.col("v")).alias("v")), self.shape, self.rank)

    def reduce(self, f) -> float:
        return float(self.df.agg(f.alias("v")).first()["v"])

    def same(self, other: Tensor) -> bool:
        return self.shape == other.shape


@dataclass
class Feed:
    """A corpus (sample_id, label, x) in mini-batches, and the cursor on it.

    Whether there is a next batch follows from the number of samples, which is counted once; the samples are put in order
    when the first batch is read.
    """

    df: DataFrame
    size: int
    at: int = 0
    done: bool = False

    @cached_property
    def ordered(self) -> corpora.Ordered:
        return corpora.Ordered(self.df, "sample_id")

    @cached_property
    def samples(self) -> int:
        return self.df.count()

    def batch(self) -> DataFrame:
        return self.ordered.batch(self.at, self.size)

    def more(self) -> bool:
        return self.at * self.size < self.samples

    def count(self) -> int:
        return self.samples


class Stop(Exception):
    """bye."""


class Machine:
    """One interpreter: data stack ``ss``, return stack ``rs``, memory, dictionary and what was printed."""

    def __init__(self, spark: SparkSession, seed: int = 0) -> None:
        self.spark, self.seed = spark, seed
        self.ss: list[Any] = []
        self.rs: list[Any] = []
        self.memory: list[float] = [10.0]
        self.words: dict[str, Any] = {}
        self.now: set[str] = set()
        self.printed: list[str] = []
        self.code: list | None = None
        self.last = ""
        self.compiling = False
        self.tokens: list[str] = []
        self.run_: summary.Run | None = None
        self.trace = 0
        self.loops: list = []
        self.leaving = False
        self._define()

    # outer interpreter

    def run(self, text: str) -> str:
        """Interpret a script; returns what it printed."""
        before = len(self.printed)
        for line in text.splitlines():
            self.line, self.at = line, 0
            try:
                while (word := self.word()) is not None:
                    self.interpret(word)
            except Stop:
                break
        return "".join(self.printed[before:])

    def word(self) -> str | None:
        n = len(self.line)
        while self.at < n and self.line[self.at].isspace():
            self.at += 1
        if self.at >= n:
            return None
        start = self.at
        while self.at < n and not self.line[self.at].isspace():
            self.at += 1
        token = self.line[start : self.at]
        # Literals may stand close to their braces.
        if len(token) > 1 and token[0] in "{}" or len(token) > 1 and token[-1] == "}":
            cut = 1 if token[0] in "{}" else len(token) - len(token.lstrip("+-.0123456789e")) or len(token)
            self.at = start + cut
            token = token[:cut]
        return token

    def until(self, mark: str) -> str:
        if self.at < len(self.line) and self.line[self.at] == " ":
            self.at += 1
        end = self.line.find(mark, self.at)
        end = len(self.line) if end < 0 else end
        text = self.line[self.at : end]
        self.at = end + 1
        return text

    def interpret(self, token: str) -> None:
        found = self.words.get(token.lower(), self.words.get(token))
        if found is not None:
            if self.compiling and token.lower() not in self.now:
                self.code.append(("call", token.lower()))
            else:
                self.execute(found)
            return
        value = self.number(token)
        if value is None:
            self.compiling = False
            raise KeyError(f"{token}?")
        if self.compiling:
            self.code.append(("lit", value))
        elif getattr(self, "literal", None) is not None:
            self.literal.append(value)
        else:
            self.ss.append(value)

    def number(self, token: str) -> float | None:
        base = int(self.memory[0])
        prefix = {"%": 2, "&": 10, "#": 10, "$": 16}
        if token[0] in prefix and len(token) > 1:
            base, token = prefix[token[0]], token[1:]
        try:
            return float(token) if "." in token and base == 10 else float(int(token, base))
        except ValueError:
            return None

    def execute(self, found) -> None:
        if callable(found):
            found()
        else:
            self.nest(found)

    def nest(self, code: list) -> None:
        """Run compiled instructions."""
        ip = 0
        while ip < len(code):
            op, arg = code[ip]
            ip += 1
            if op == "lit":
                self.ss.append(arg)
            elif op == "call":
                self.execute(self.words[arg])
            elif op == "do":
                arg()
            elif op == "jump":
                ip = arg
            elif op == "zero":
                if not self.truth(self.ss.pop()):
                    ip = arg
            elif op == "for":
                self.rs.append(self.ss.pop())
            elif op == "next":
                top = self.rs[-1]
                if isinstance(top, Feed):
                    top.at += 1
                    if top.more():
                        ip = arg
                    else:
                        top.done = True
                        self.rs.pop()
                        for x in self.ss:
                            if isinstance(x, Model):
                                x.epoch += 1
                else:
                    self.rs[-1] = top - 1
                    if self.rs[-1] >= 0:
                        ip = arg
                    else:
                        self.rs.pop()
            elif op == "begin-do":
                start, limit = self.ss.pop(), self.ss.pop()
                self.rs += [limit, start]
            elif op == "loop":
                self.rs[-1] += 1
                if self.rs[-1] < self.rs[-2]:
                    ip = arg
                else:
                    del self.rs[-2:]
            elif op == "leave":
                del self.rs[-2:]
                return
            elif op == "exit":
                return
            elif op == "does":
                rest = code[ip:]
                address = self.words[self.last]
                self.words[self.last] = lambda a=address, r=rest: (a(), self.nest(r))[0]
                return

    @staticmethod
    def truth(x) -> bool:
        return abs(x) > S.EPS

    # helpers

    def pop(self) -> Any:
        if not self.ss:
            raise IndexError("stack is empty")
        return self.ss.pop()

    def flag(self, x: bool) -> None:
        self.ss.append(TRUE if x else FALSE)

    def say(self, text: str) -> None:
        self.printed.append(text)

    def tensor(self, values: np.ndarray, shape: tuple[int, int, int, int], rank: int) -> Tensor:
        flat = np.asarray(values, float).ravel()
        return Tensor(self.spark.createDataFrame([(i, float(v)) for i, v in enumerate(flat)], "k bigint, v double"), shape, rank)

    def filled(self, shape: tuple[int, int, int, int], rank: int, v: Any = 0.0) -> Tensor:
        column = v if not isinstance(v, (int, float)) else F.lit(float(v))
        return Tensor(self.spark.range(math.prod(shape)).select(F.col("id").alias("k"), column.cast("double").alias("v")), shape, rank)

    def from_cells(self, df: DataFrame, h: int, w: int) -> Tensor:
        return Tensor(df.select((F.col("i").cast("bigint") * w + F.col("j")).alias("k"), "v"), (1, h, w, 1), 2)

    def settled(self, t: Tensor) -> Tensor:
        """t read once: small results that many plans start from."""
        return self.tensor(t.values(), t.shape, t.rank)

    def top(self) -> Any:
        if not self.ss:
            raise IndexError("stack is empty")
        return self.ss[-1]

    def binary(self, op: str, drop: bool = False) -> None:
        b, a = self.pop(), self.pop()
        result: Any
        if isinstance(a, Tensor) and isinstance(b, Tensor):
            if a.shape[1:] != b.shape[1:] or (a.shape[0] != b.shape[0] and 1 not in (a.shape[0], b.shape[0])):
                raise ValueError(f"shapes {a.shape} and {b.shape}")
            big, small = (a, b) if a.shape[0] >= b.shape[0] else (b, a)
            one = math.prod(a.shape[1:])
            left = big.df.select("k", F.col("v").alias("x"), (F.col("k") % one if small.shape[0] < big.shape[0] else F.col("k")).alias("m"))
            right = small.df.select(F.col("k").alias("m"), F.col("v").alias("y"))
            x, y = (F.col("x"), F.col("y")) if big is a else (F.col("y"), F.col("x"))
            result = Tensor(left.join(right, "m").select("k", S.BINARY[op](x, y).alias("v")), big.shape, big.rank)
        elif isinstance(a, Tensor):
            result = a.map(lambda v: S.BINARY[op](v, F.lit(float(b))))
        elif isinstance(b, Tensor):
            result = b.map(lambda v: S.BINARY[op](F.lit(float(a)), v))
        else:
            self.ss.append({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]())
            return
        if not drop:
            self.ss += [a, b]
        self.ss.append(result)

    def unary(self, name: str, plain: Callable[[float], float]) -> None:
        a = self.pop()
        if isinstance(a, Model):
            self.ss.append(a.activation(name))
        elif isinstance(a, Tensor):
            self.ss.append(a.map(S.UNARY[name]))
        else:
            self.ss.append(plain(a))

    def product(self, a: Any, b: Any) -> Any:
        if a.rank == 1 and b.rank == 1:
            if a.size != b.size:
                raise ValueError(f"lengths {a.size} and {b.size}")
            return float(a.df.join(b.df.withColumnRenamed("v", "y"), "k").agg(F.sum(F.col("v") * F.col("y")).alias("v")).first()["v"])
        (n, h, w, _), (m, k, j, _) = a.shape, b.shape
        if w != k or (n != m and 1 not in (n, m)):
            raise ValueError(f"shapes {a.shape} and {b.shape}")
        if n == m == 1:
            out = self.from_cells(coo.matmul(a.cells(), b.cells()), h, j)
            return Tensor(out.df, (1, h, j, 1), 1 if b.rank == 1 else 2)

        def by_sample(t: Tensor) -> DataFrame:
            one = t.shape[1] * t.shape[2]
            return t.df.select(F.expr(f"k div {one}").alias("n"), F.expr(f"k % {one} div {t.shape[2]}").alias("i"), (F.col("k") % t.shape[2]).alias("j"), "v")

        x, y = by_sample(a), by_sample(b)
        if m == 1:
            got = coo.batch_matmul(x, coo.spread(y.drop("n"), b.size), shared=True)
        elif n == 1:
            left = x.select("i", F.col("j").alias("k"), F.col("v").alias("p"))
            right = y.select("n", F.col("i").alias("k"), "j", F.col("v").alias("q"))
            got = coo.spread(left, a.size).join(right, "k").groupBy("n", "i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
        else:
            got = coo.batch_matmul(x, y)
        top = max(n, m)
        return Tensor(got.select(((F.col("n") * h + F.col("i")) * j + F.col("j")).alias("k"), "v"), (top, h, j, 1), 4)

    def at_sign(self) -> None:
        if len(self.ss) > 1 and isinstance(self.ss[-1], Tensor) and isinstance(self.ss[-2], Tensor):
            self.ss.append(self.product(self.ss[-2], self.ss[-1]))
        else:
            self.ss.append(self.memory[int(self.pop())])

    def literal_of(self, shape: tuple[int, int, int, int], rank: int, base: Tensor | None = None, offset: int = 0) -> None:
        """Read numbers up to the brace that closes the literal."""
        depth, got = 1, []
        while depth:
            token = self.word()
            if token is None:
                raise ValueError("literal isn't closed")
            if token == "{":
                depth += 1
            elif token == "}":
                depth -= 1
            else:
                got.append(self.number(token))
        size = math.prod(shape)
        if offset + len(got) > size or base is None and len(got) != size:
            raise ValueError(f"{len(got)} numbers for {size} cells")
        values = np.zeros(size) if base is None else base.values()
        values[offset : offset + len(got)] = got
        self.ss.append(self.tensor(values, shape, rank))

    def text(self) -> str:
        """A string pushed by s\"."""
        self.pop()
        return self.pop()

    def show(self, x: Any) -> str:
        if isinstance(x, Tensor):
            v = x.values()
            rows = v.reshape(-1, x.shape[2]) if x.rank > 1 else v.reshape(1, -1)
            body = [" ".join(f"{a:+.4f}" for a in r[:3]) + (" ... " + " ".join(f"{a:+.4f}" for a in r[-3:]) if len(r) > 10 else "".join(f" {a:+.4f}" for a in r[3:])) for r in rows]
            if len(body) > 10:
                body = [*body[:3], "...", *body[-3:]]
            name = {1: f"vector[{x.size}]", 2: f"matrix[{x.shape[1]},{x.shape[2]}]"}.get(x.rank, f"tensor{list(x.shape)}")
            return name + " = {" + " }{".join(body) + "}\n"
        if isinstance(x, Model):
            return "\n".join(f"{r['layer']} {r['op']} [{r['n']},{r['h']},{r['w']},{r['c']}] {r['n_params']}" for r in x.describe(self.spark).collect()) + "\n"
        if isinstance(x, Feed):
            return f"dataset of batches of {x.size}, at {x.at}\n"
        return self.plain(x) + " "

    def plain(self, x: Any) -> str:
        if isinstance(x, str):
            return x
        base = int(self.memory[0])
        if base == 16:
            return format(int(x) & 0xFFFFFFFF, "x") if x < 0 else format(int(x), "x")
        if base == 2:
            return format(int(x), "b")
        return f"{x:.6g}"

    # dictionary

    def _define(self) -> None:
        w, ss = self.words, self.ss

        def put(name: str, f: Callable[[], Any], now: bool = False) -> None:
            w[name] = f
            if now:
                self.now.add(name)

        def one(f: Callable) -> Callable[[], None]:
            return lambda: ss.append(f(self.pop()))

        def two(f: Callable) -> Callable[[], None]:
            def go() -> None:
                b, a = self.pop(), self.pop()
                ss.append(f(a, b))

            return go

        def test(f: Callable) -> Callable:
            return two(lambda a, b: TRUE if f(a, b) else FALSE)

        def shuffle(n: int, *order: int) -> Callable[[], None]:
            def go() -> None:
                if len(ss) < n:
                    raise IndexError("stack is empty")
                items = ss[-n:]
                del ss[-n:]
                ss.extend(items[i] for i in order)

            return go

        whole = lambda x: int(x)
        wrap = lambda x: float((int(x) + (1 << 31)) % (1 << 32) - (1 << 31))
        for name, n, order in (("nop", 0, ()), ("dup", 1, (0, 0)), ("drop", 1, ()), ("over", 2, (0, 1, 0)), ("swap", 2, (1, 0)), ("rot", 3, (1, 2, 0)), ("-rot", 3, (2, 0, 1)), ("nip", 2, (1,)), ("2dup", 2, (0, 1, 0, 1)), ("2drop", 2, ()), ("2over", 4, (0, 1, 2, 3, 0, 1)), ("2swap", 4, (2, 3, 0, 1))):
            put(name, shuffle(n, *order) if n else lambda: None)
        put("pick", lambda: ss.append(ss[-1 - int(self.pop())]))
        put("?dup", lambda: ss.append(ss[-1]) if self.truth(self.top()) else None)
        for op in "+-*/":
            put(op, lambda op=op: self.binary(op))
            put(op + "=", lambda op=op: self.binary(op, True))
        put("mod", two(lambda a, b: math.fmod(whole(a), whole(b))))
        put("fmod", two(math.fmod))
        put("/mod", lambda: (lambda b, a: ss.extend([math.fmod(a, b), a / b]))(self.pop(), self.pop()))
        put("*/", lambda: (lambda c, b, a: ss.append(a * b / c))(self.pop(), self.pop(), self.pop()))
        put("*/mod", lambda: (lambda c, b, a: ss.extend([math.fmod(a * b, c), float(math.floor(a * b / c))]))(self.pop(), self.pop(), self.pop()))
        put("and", two(lambda a, b: wrap(whole(a) & whole(b))))
        put("or", two(lambda a, b: wrap(whole(a) | whole(b))))
        put("xor", two(lambda a, b: wrap(whole(a) ^ whole(b))))
        put("invert", one(lambda a: wrap(~whole(a))))
        put("rshift", two(lambda a, b: wrap(whole(a) >> whole(b))))
        put("lshift", two(lambda a, b: wrap(whole(a) << whole(b))))
        for name, f in (("2*", lambda a: a * 2), ("2/", lambda a: a / 2), ("1+", lambda a: a + 1), ("1-", lambda a: a - 1), ("f>s", lambda a: float(int(a))), ("round", lambda a: math.copysign(math.floor(abs(a) + 0.5), a)), ("ceil", lambda a: float(math.ceil(a))), ("floor", lambda a: float(math.floor(a)))):
            put(name, one(f))
        for name, f in {
            "abs": abs, "negate": lambda x: -x, "exp": math.exp, "tanh": math.tanh, "sigmoid": lambda x: 1 / (1 + math.exp(-x)), "sqrt": lambda x: math.sqrt(max(x, 0)), "1/x": lambda x: 1 / x,
            "sat": lambda x: min(1.0, max(0.0, x)), "ln": lambda x: math.log(x) if x > S.EPS else 0.0, "log": lambda x: math.log10(x) if x > S.EPS else 0.0, "relu": lambda x: max(0.0, x), "sin": math.sin, "cos": math.cos,
        }.items():
            put(name, lambda name=name, f=f: self.unary(name, f))
        put("selu", lambda: ss.append(self.pop().selu()))
        put("leakyrelu", lambda: self._with_default("leakyrelu", 0.01))
        put("elu", lambda: self._with_default("elu", 1.0))
        put("pow", lambda: (lambda b, a: ss.append(a.map(lambda v: F.pow(v, F.lit(float(b)))) if isinstance(a, Tensor) else b**a))(self.pop(), self.pop()))
        put("pi", lambda: ss.append(3.1415927))
        for name, f in (("0=", lambda a: abs(a) < S.EPS), ("0<", lambda a: a < -S.EPS), ("0>", lambda a: a > S.EPS)):
            put(name, one(lambda a, f=f: TRUE if f(a) else FALSE))
        for name, f in (("=", lambda a, b: abs(a - b) < S.EPS), (">", lambda a, b: a - b > S.EPS), ("<", lambda a, b: a - b < -S.EPS), ("<>", lambda a, b: abs(a - b) >= S.EPS), (">=", lambda a, b: not a - b < -S.EPS), ("<=", lambda a, b: not a - b > S.EPS), ("u<", lambda a, b: whole(a) % (1 << 32) < whole(b) % (1 << 32)), ("u>", lambda a, b: whole(a) % (1 << 32) > whole(b) % (1 << 32))):
            put(name, test(f))
        self._define_console(put)
        self._define_control(put)
        self._define_memory(put)
        self._define_tensors(put)
        self._define_models(put)
        self._define_runs(put)

    def _define_console(self, put: Callable) -> None:
        ss = self.ss
        put("base", lambda: ss.append(0.0))
        put("decimal", lambda: self.memory.__setitem__(0, 10.0))
        put("hex", lambda: self.memory.__setitem__(0, 16.0))
        put("bl", lambda: ss.append(32.0))
        put("cr", lambda: self.say("\n"))
        put(".", lambda: self.say(self.show(self.pop())))
        put("u.", lambda: self.say(f"{int(self.pop()) % (1 << 32)} "))
        put(".r", lambda: (lambda n, x: self.say(self.plain(x).rjust(int(n))))(self.pop(), self.pop()))
        put("u.r", lambda: (lambda n, x: self.say(str(int(x) % (1 << 32)).rjust(int(n))))(self.pop(), self.pop()))
        put("type", lambda: self.say(self.text()))
        put("key", lambda: ss.append(0.0))
        put("emit", lambda: self.say(chr(int(self.pop()))))
        put("space", lambda: self.say(" "))
        put("spaces", lambda: self.say(" " * int(self.pop())))
        put("(", lambda: self.until(")"), True)
        put(".(", lambda: self.say(self.until(")")), True)
        put("\\", lambda: setattr(self, "at", len(self.line)), True)

        def quoted(then: Callable[[str], None]) -> Callable[[], None]:
            def go() -> None:
                text = self.until('"')
                if self.compiling:
                    self.code.append(("do", lambda: then(text)))
                else:
                    then(text)

            return go

        put('s"', quoted(lambda t: ss.extend([t, float(len(t))])), True)
        put('."', quoted(self.say), True)

        def sprintf() -> None:
            """Takes its numbers from the stack, the last for the last mark."""
            form, parts = self.text(), []
            marks = [i for i in range(len(form) - 1) if form[i] == "%"]
            i = len(form)
            for at in reversed([m for m in marks if not (m and form[m - 1] == "%")]):
                kind = form[at + 1]
                value = "%" if kind == "%" else {"d": lambda x: str(int(x)), "x": lambda x: format(int(x), "x"), "f": lambda x: f"{x:f}", "g": lambda x: f"{x:g}", "p": lambda x: hex(int(x)), "s": str}[kind](self.text() if kind == "s" else self.pop())
                parts = [value, form[at + 2 : i], *parts]
                i = at
            done = form[:i] + "".join(parts)
            ss.extend([done, float(len(done))])

        put("sprintf", sprintf)
        put("abort", lambda: (ss.clear(), self.rs.clear()))
        put("here", lambda: ss.append(float(len(self.memory))))
        put("'", lambda: ss.append(self.word().lower()))
        put(".s", lambda: self.say(" ".join(self.show(x).strip() for x in ss) + " "))
        put("depth", lambda: ss.append(float(len(ss))))
        for name in ("words", "dict", "dict_dump"):
            put(name, lambda: self.say(" ".join(sorted(self.words)) + "\n"))
        put("see", lambda: (lambda n: self.say(f"{n} = {self.words[n]}\n"))(self.word().lower()))
        put("dump", lambda: (lambda n, a: self.say(" ".join(f"{x:g}" for x in self.memory[int(a) : int(a) + int(n)]) + "\n"))(self.pop(), self.pop()))
        put("forget", lambda: self.words.pop(self.word().lower(), None))
        put("trace", lambda: setattr(self, "trace", int(self.pop())))
        put("mstat", lambda: self.say(f"{len(ss)} on the stack, {len(self.memory)} cells, {len(self.words)} words\n"))
        put("ms", lambda: time.sleep(self.pop() / 1000))
        put("flush", lambda: None)
        put("clock", lambda: ss.append(time.time() * 1000 % (1 << 24)))

        def bye() -> None:
            raise Stop

        put("bye", bye)
        put("boot", lambda: (self.words.clear(), self._define()))

    def _define_control(self, put: Callable) -> None:
        mark: list = []
        code = lambda: self.code

        def hold(op: str) -> Callable[[], None]:
            def go() -> None:
                code().append((op, None))
                mark.append(len(code()) - 1)

            return go

        def patch(at: int) -> None:
            code()[at] = (code()[at][0], len(code()))

        def else_() -> None:
            at = mark.pop()
            hold("jump")()
            patch(at)

        def repeat() -> None:
            out, back = mark.pop(), mark.pop()
            code().append(("jump", back))
            patch(out)

        def aft() -> None:
            mark.pop()
            hold("jump")()
            at = mark.pop()
            mark.extend([len(code()), at])

        def emit(op: str) -> Callable[[], None]:
            return lambda: code().append((op, None))

        def opening(op: str) -> Callable[[], None]:
            def go() -> None:
                if not self.compiling and op == "for":
                    self.code, self.compiling, self.temporary = [], True, True
                code().append((op, None))
                mark.append(len(code()))

            return go

        def closing(op: str) -> Callable[[], None]:
            def go() -> None:
                code().append((op, mark.pop()))
                if getattr(self, "temporary", False) and not mark:
                    made, self.code, self.compiling, self.temporary = self.code, None, False, False
                    self.nest(made)

            return go

        put("if", hold("zero"), True)
        put("else", else_, True)
        put("then", lambda: patch(mark.pop()), True)
        put("begin", lambda: mark.append(len(code())), True)
        put("again", lambda: code().append(("jump", mark.pop())), True)
        put("until", lambda: code().append(("zero", mark.pop())), True)
        put("while", hold("zero"), True)
        put("repeat", repeat, True)
        put("for", opening("for"), True)
        put("next", closing("next"), True)
        put("aft", aft, True)
        put("do", opening("begin-do"), True)
        put("loop", closing("loop"), True)
        put("i", lambda: self.ss.append(self.rs[-1]))
        put("leave", emit("leave"), True)
        put("exit", emit("exit"), True)
        put(">r", lambda: self.rs.append(self.pop()))
        put("r>", lambda: self.ss.append(self.rs.pop()))
        put("r@", lambda: self.ss.append(self.rs[-1]))
        put("[", lambda: setattr(self, "compiling", False), True)
        put("]", lambda: setattr(self, "compiling", True))

        def colon() -> None:
            self.last = self.word().lower()
            self.code, self.compiling = [], True
            self.words[self.last] = self.code

        def semicolon() -> None:
            self.code, self.compiling = None, False

        put(":", colon)
        put(";", semicolon, True)
        put("immediate", lambda: self.now.add(self.last))
        put("exec", lambda: self.execute(self.words[self.pop()]))
        put("does>", emit("does"), True)

    def _define_memory(self, put: Callable) -> None:
        ss, m = self.ss, self.memory

        def made(cells: list[float]) -> None:
            self.last = self.word().lower()
            at = float(len(m))
            m.extend(cells)
            self.words[self.last] = lambda: ss.append(at)

        def constant() -> None:
            name, value = self.word().lower(), self.pop()
            self.words[name] = lambda: ss.append(value)

        def value() -> None:
            name, box = self.word().lower(), [self.pop()]
            self.boxes = getattr(self, "boxes", {})
            self.boxes[name] = box
            self.words[name] = lambda: ss.append(box[0])

        def to() -> None:
            name = self.word().lower()
            if self.compiling:
                self.code.append(("do", lambda: self.boxes[name].__setitem__(0, self.pop())))
            else:
                self.boxes[name][0] = self.pop()

        put("variable", lambda: made([0.0]))
        put("create", lambda: made([]))
        put("constant", constant)
        put("value", value)
        put("to", to, True)
        put("[to]", to, True)
        put("is", lambda: (lambda n: self.words.__setitem__(n, self.words[self.pop()]))(self.word().lower()))
        put("!", lambda: (lambda a, n: m.__setitem__(int(a), n))(self.pop(), self.pop()))
        put("c@", lambda: ss.append(float(int(m[int(self.pop())]) & 255)))
        put("c!", lambda: (lambda a, n: m.__setitem__(int(a), float(int(n) & 255)))(self.pop(), self.pop()))
        put("+!", lambda: (lambda a, n: m.__setitem__(int(a), m[int(a)] + n))(self.pop(), self.pop()))
        put("?", lambda: self.say(self.plain(m[int(self.pop())]) + " "))
        put(",", lambda: m.append(self.pop()))
        put("cells", lambda: None)
        put("allot", lambda: m.extend([0.0] * int(self.pop())))
        put("th", lambda: (lambda i, a: ss.append(a + i))(self.pop(), self.pop()))

    def _define_tensors(self, put: Callable) -> None:
        ss = self.ss

        def new(rank: int) -> Callable[[], None]:
            def go() -> None:
                dims = [int(self.pop()) for _ in range({1: 1, 2: 2, 4: 4}[rank])][::-1]
                shape = {1: (1, dims[0], 1, 1), 2: (1, *dims, 1)[:4], 4: tuple(dims)}[rank]
                ss.append(self.filled(shape, rank))

            return go

        for name, rank in (("vector", 1), ("matrix", 2), ("tensor", 4)):
            put(name, new(rank))
        put("vector{", lambda: (lambda n: self.literal_of((1, n, 1, 1), 1))(int(self.pop())))
        put("matrix{", lambda: (lambda w, h: self.literal_of((1, h, w, 1), 2))(int(self.pop()), int(self.pop())))

        def fill_in() -> None:
            offset = 0 if isinstance(self.top(), Tensor) else int(self.pop())
            t = self.pop()
            self.literal_of(t.shape, t.rank, t, offset)

        put("={", fill_in)
        put("view", lambda: ss.append(self.top()))
        put("copy", lambda: ss.append(self.top()))

        def flat() -> None:
            a = self.pop()
            ss.append(a.flatten() if isinstance(a, Model) else Tensor(a.df, (1, a.size, 1, 1), 1))

        put("flatten", flat)

        def reshape(rank: int) -> Callable[[], None]:
            def go() -> None:
                dims = [int(self.pop()) for _ in range(rank)][::-1]
                shape = (1, *dims, 1) if rank == 2 else tuple(dims)
                if math.prod(shape) != self.top().size:
                    raise ValueError(f"{self.top().size} cells into {shape}")
                t = self.pop()
                ss.append(Tensor(t.df, shape, rank))

            return go

        put("reshape2", reshape(2))
        put("reshape4", reshape(4))
        put("same_shape?", lambda: self.flag(ss[-1].same(ss[-2])))
        for name, v in (("zeros", 0.0), ("ones", 1.0)):
            put(name, lambda v=v: (lambda t: ss.append(self.filled(t.shape, t.rank, v)))(self.pop()))
        put("fill", lambda: (lambda v, t: ss.append(self.filled(t.shape, t.rank, v)))(self.pop(), self.pop()))
        put("gradfill", lambda: (lambda t: ss.append(self.filled(t.shape, t.rank, F.col("id") / F.lit(float(t.size)))))(self.pop()))

        def eye() -> None:
            t = self.pop()
            _, h, w, c = t.shape
            row, column = F.expr(f"id div {w * c} % {h}"), F.expr(f"id div {c} % {w}")
            ss.append(self.filled(t.shape, t.rank, F.when(row == column, 1.0).otherwise(0.0)))

        put("eye", eye)

        def random(f: Callable) -> Callable[[], None]:
            def go() -> None:
                self.seed += 1
                t = self.pop()
                # Read once: a plan drawn again would give other numbers.
                ss.append(self.settled(self.filled(t.shape, t.rank, f(self.seed))))

            return go

        put("rand", random(lambda s: 1.0 - F.rand(s)))
        put("randn", random(F.randn))

        def reduction(f) -> Callable[[], None]:
            return lambda: ss.append(self.top().reduce(f))

        v = F.col("v")
        for name, f in (("sum", F.sum(v)), ("avg", F.avg(v)), ("std", F.stddev_pop(v)), ("norm", F.sqrt(F.sum(v * v)))):
            put(name, reduction(f))
        put("max", lambda: ss.append(self.top().reduce(F.max(v))) if isinstance(self.top(), Tensor) else ss.append(max(self.pop(), self.pop())))
        put("min", lambda: ss.append(self.top().reduce(F.min(v))) if isinstance(self.top(), Tensor) else ss.append(min(self.pop(), self.pop())))
        put("{", lambda: None)
        put("}", lambda: None)
        put("dim", lambda: ss.append(self.tensor(np.array(self.top().shape), (1, 4, 1, 1), 1)))

        def cut() -> None:
            y1, y0, x1, x0 = (int(self.pop()) for _ in range(4))
            t = self.top()
            n, h, wide, c = t.shape
            x1, y1 = wide if x1 < 0 else x1, h if y1 < 0 else y1
            k = F.col("k")
            row, column = F.expr(f"k div {wide * c} % {h}"), F.expr(f"k div {c} % {wide}")
            kept = t.df.where((row >= y0) & (row < y1) & (column >= x0) & (column < x1))
            place = ((F.expr(f"k div {h * wide * c}") * (y1 - y0) + row - y0) * (x1 - x0) + column - x0) * c + k % c
            ss.append(Tensor(kept.select(place.alias("k"), "v"), (n, y1 - y0, x1 - x0, c), t.rank))

        put("slice", cut)
        put("t@", lambda: (lambda i: ss.append(float(self.top().df.where(F.col("k") == int(i)).first()["v"])))(self.pop()))
        put("t!", lambda: (lambda x, i, t: ss.append(Tensor(t.df.withColumn("v", F.when(F.col("k") == int(i), F.lit(float(x))).otherwise(F.col("v"))), t.shape, t.rank)))(self.pop(), self.pop(), self.pop()))

        def square(f: Callable) -> Callable[[], None]:
            def go() -> None:
                t = self.top()
                if t.shape[1] != t.shape[2]:
                    raise ValueError(f"not square: {t.shape}")
                ss.append(self.settled(self.from_cells(f(t.cells()), t.shape[1], t.shape[2])))

            return go

        put("inverse", square(linalg.inverse))
        put("luinv", square(linalg.lu_inverse))
        put("upper", square(coo.upper))
        put("lower", square(coo.lower))
        put("transpose", lambda: ss.append(self.from_cells(coo.transpose(self.top().cells()), self.top().shape[2], self.top().shape[1])))
        put("det", lambda: ss.append(float(linalg.det(self.top().cells()).first()["v"])))

        def plu() -> None:
            t = self.top()
            parts = linalg.plu(t.cells())
            for name in ("P", "LU"):
                ss.append(self.settled(self.from_cells(parts.where(F.col("part") == name), t.shape[1], t.shape[1])))

        put("plu", plu)
        put("@", self.at_sign)
        put("matmul", lambda: ss.append(self.product(ss[-2], ss[-1])))
        put("@=", lambda: (lambda b, a: ss.append(self.product(a, b)))(self.pop(), self.pop()))

        def matdiv() -> None:
            a, b = ss[-2], ss[-1]
            ss.append(self.product(a, self.from_cells(linalg.inverse(b.cells()), b.shape[1], b.shape[2])))

        put("matdiv", matdiv)

        def solve() -> None:
            b, a = ss[-2], ss[-1]
            x = linalg.solve(a.cells(), b.df.select(F.col("k").cast("int").alias("i"), "v"))
            ss.append(self.settled(Tensor(x.select(F.col("i").cast("bigint").alias("k"), "v"), (1, b.size, 1, 1), 1)))

        put("solve", solve)

        def gemm() -> None:
            alpha, beta, a, b, c = ss[-5:]
            ss.append(self.from_cells(coo.gemm(alpha, beta, a.cells(), b.cells(), c.cells()), c.shape[1], c.shape[2]))

        for name in ("gemm", "gemm1", "gemm2", "gemm3", "gemm4"):
            put(name, gemm)
        put("softmax", lambda: self._soft("softmax"))
        put("logsoftmax", lambda: self._soft("logsoftmax"))

        def normalize() -> None:
            if isinstance(self.top(), Tensor):
                t = self.pop()
                m, s = t.reduce(F.avg(v)), t.reduce(F.stddev_pop(v))
                ss.append(t.map(lambda x: (x - m) / s))
            else:
                scale, mean, feed = self.pop(), self.pop(), self.pop()
                ss.append(Feed(feed.df.withColumn("x", corpora.normalize(F.col("x"), mean, scale)), feed.size))

        put("normalize", normalize)

    def _soft(self, name: str) -> None:
        a = self.pop()
        if isinstance(a, Model):
            self.ss.append(a.softmax() if name == "softmax" else a.logsoftmax())
            return
        top = a.reduce(F.max("v"))
        total = a.reduce(F.sum(F.exp(F.col("v") - top)))
        self.ss.append(a.map(lambda v: F.exp(v - top) / total if name == "softmax" else v - top - math.log(total)))

    def _with_default(self, name: str, default: float) -> None:
        a = self.pop() if not isinstance(self.top(), (Model, Tensor)) else default
        m = self.pop()
        self.ss.append(m.activation(name, a) if isinstance(m, Model) else m.map(lambda v: getattr(S, {"leakyrelu": "leaky"}.get(name, name))(v, a)))

    # models

    def model(self) -> Model:
        found = next((x for x in reversed(self.ss) if isinstance(x, Model)), None)
        if found is None:
            raise IndexError("no model on the stack")
        return found

    def as_samples(self, x: Any, m: Model) -> DataFrame:
        """(id, x, t) of a tensor, one sample for each n, or of a feed's batch with its labels one-hot."""
        if isinstance(x, Feed):
            classes = math.prod(m.out)
            return x.batch().select(F.col("sample_id").alias("id"), "x", losses.onehot(F.col("label"), classes).alias("t"))
        one = math.prod(m.shape)
        if x.size % one:
            raise ValueError(f"{x.size} values for samples of {one}")
        cells = F.struct((F.col("k") % one).alias("k"), "v")
        return x.df.groupBy(F.expr(f"k div {one}").alias("id")).agg(F.transform(F.array_sort(F.collect_list(cells)), lambda s: s["v"]).alias("x"))

    def output(self, m: Model, upto: int | None = None) -> Tensor:
        got = m.forward(m.input, upto).orderBy("id").collect()
        shape = m.shape if upto == 0 else m.layers[(upto or len(m.layers)) - 1].shape if m.layers else m.shape
        return self.tensor(np.array([r["x"] for r in got]), (len(got), *shape), 4)

    def targets(self, m: Model) -> Tensor:
        if getattr(m, "target", None) is None:
            got = m.input.select("id", "t").orderBy("id").collect()
            m.target = self.tensor(np.array([r["t"] for r in got]), (len(got), *m.out), 4)
        return m.target

    def _loss(self, name: str) -> None:
        t = self.pop() if isinstance(self.top(), Tensor) else None
        o = self.top()
        if isinstance(o, Model):
            t = t or self.targets(o)
            o = self.output(o)
        n = o.shape[0]
        both = o.df.select("k", F.col("v").alias("o")).join(t.df.select("k", F.col("v").alias("t")), "k")
        self.ss.append(float(both.agg(F.sum(losses.per_cell(name, F.col("o"), F.col("t"))).alias("v")).first()["v"]) / n)

    def _define_models(self, put: Callable) -> None:
        ss = self.ss

        def model() -> None:
            c, wide, h, n = (int(self.pop()) for _ in range(4))
            ss.append(Model(n, (h, wide, c), "ref", self.seed))

        put("nn.model", model)

        def conv() -> None:
            k, stride, pad = 3, 1, 1
            if isinstance(self.top(), Tensor):
                k, stride, pad = (int(x) for x in self.pop().values()[:3])
            c, b = int(self.pop()), self.pop()
            ss.append(self.pop().conv2d(b, c, k, stride, pad))

        put("conv2d", conv)
        put("conv1x1", lambda: (lambda c, b: ss.append(self.pop().conv1x1(b, int(c))))(self.pop(), self.pop()))
        put("dconv2d", lambda: (lambda c, b: ss.append(self.pop().dconv2d(b, int(c))))(self.pop(), self.pop()))

        def linear() -> None:
            n = int(self.pop())
            b = 1.0 if isinstance(self.top(), Model) else self.pop()
            ss.append(self.pop().linear(n, b))

        put("linear", linear)
        for name in ("maxpool", "avgpool", "minpool"):
            put(name, lambda name=name: (lambda k: ss.append(self.pop().pool(name, int(k))))(self.pop()))
        put("dropout", lambda: (lambda p: ss.append(self.pop().dropout(p)))(self.pop()))
        put("batchnorm", lambda: (lambda a: ss.append(self.pop().batchnorm(a)))(0.1 if isinstance(self.top(), Model) else self.pop()))

        def upsample() -> None:
            k = int(self.pop())
            if not isinstance(self.top(), Model):
                self.pop()
            ss.append(self.pop().upsample(k))

        put("upsample", upsample)
        put(">n", lambda: (lambda t, m: ss.append(m.flatten()))(self.pop(), self.pop()))
        put("n@", lambda: (lambda i: ss.append(self.output(self.model(), int(i) if i >= 0 else len(self.model().layers) + int(i) + 1)))(self.pop()))

        def reader(name: str, grad: bool) -> Callable[[], None]:
            def go() -> None:
                i = int(self.pop())
                m = self.model()
                a = (m.gradients if grad else m.params)[i - 1 if i > 0 else len(m.layers) + i, name]
                dims = (1, a.shape[0], a.shape[1] if a.ndim == 2 else 1, 1) if a.ndim < 3 else (a.shape[0], a.shape[1], a.shape[2], a.shape[3])
                ss.append(self.tensor(a, dims, {1: 1, 2: 2}.get(a.ndim, 4)))

            return go

        for word, name, grad in (("nn.w", "w", False), ("nn.b", "b", False), ("nn.dw", "w", True), ("nn.db", "b", True)):
            put(word, reader(name, grad))
        put("nn.ex", lambda: (lambda i: ss.append(self.tensor(np.array([p.size for (j, _), p in sorted(self.model().params.items()) if j == int(i) - 1]), (1, 2, 1, 1), 1)))(self.pop()))
        for word, name in (("nn.w=", "w"), ("nn.b=", "b")):
            put(word, lambda name=name: (lambda i, t: self.model().set(int(i) - 1, name, t.values()))(self.pop(), self.pop()))

        def forward() -> None:
            x = self.pop() if isinstance(self.top(), (Tensor, Feed)) else next(r for r in reversed(self.rs) if isinstance(r, Feed))
            m = self.top()
            m.input, m.target = self.as_samples(x, m), None

        put("forward", forward)

        def backprop() -> None:
            t = self.pop() if isinstance(self.top(), Tensor) else None
            m = self.top()
            t = t or getattr(m, "target", None)
            df = m.input
            if t is not None:
                one = t.size // t.shape[0]
                cells = F.struct((F.col("k") % one).alias("k"), "v")
                rows = t.df.groupBy(F.expr(f"k div {one}").alias("id")).agg(F.transform(F.array_sort(F.collect_list(cells)), lambda s: s["v"]).alias("t"))
                df = df.select("id", "x").join(rows, "id")
            m.backprop(df)

        put("backprop", backprop)

        def spread() -> None:
            t, m = self.pop(), self.top()
            m.target = self.tensor(np.repeat(t.values().reshape(-1, 1), math.prod(m.out), 1), (t.size, *m.out), 4)

        put("broadcast", spread)
        put("trainable", lambda: (lambda f: setattr(self.model(), "trainable", self.truth(f)))(self.pop()))
        put("predict", lambda: None)
        put("batchsize", lambda: ss.append(float(self.model().batch)))
        put("nn.len", lambda: (lambda x: ss.append(float(x.size if isinstance(x, Tensor) else x.count() if isinstance(x, Feed) else len(x.layers))))(self.top()))
        for name in ("mse", "bce", "ce", "nll"):
            put(f"loss.{name}", lambda name=name: self._loss(name))
        put("nn.loss", lambda: self._loss((self.top() if isinstance(self.top(), Model) else ss[-2]).loss()))
        put("nn.onehot", lambda: ss.append(self.targets(self.model())))
        put("nn.onehot=", lambda: (lambda t: setattr(self.model(), "target", t))(self.pop()))

        def hit() -> None:
            m = self.model()
            o, t = self.output(m).values().reshape(-1, math.prod(m.out)), self.targets(m).values().reshape(-1, math.prod(m.out))
            ss.append(float(t[np.arange(len(o)), o.argmax(1)].sum()))

        put("nn.hit", hit)

        def optimiser(f: Callable) -> Callable[[], None]:
            def go() -> None:
                args = []
                while not isinstance(self.top(), Model):
                    args.insert(0, self.pop())
                f(self.top(), *args)

            return go

        put("nn.sgd", optimiser(lambda m, lr, beta=0.9: m.sgd(lr, beta)))
        put("nn.adam", optimiser(lambda m, lr, b1=0.9: m.adam(lr, b1)))
        put("nn.adamw", optimiser(lambda m, lr, wd=0.01: m.adamw(lr, wd)))
        put("nn.max_norm", optimiser(lambda m, v: setattr(m, "max_norm", v)))
        put("nn.zero", lambda: self.model().zero())
        put("network", lambda: self.say(self.show(self.top())))

        def dataset() -> None:
            n = int(self.pop())
            if n < 1:
                raise ValueError(f"batches of {n}")
            ss.append(Feed(corpora.samples(self.spark, self.word()), n))

        put("dataset", dataset)
        put("fetch", lambda: setattr(self.top(), "at", self.top().at + 1))
        put("rewind", lambda: (setattr(self.top(), "at", 0), setattr(self.top(), "done", False)))

    # files and runs

    def _define_runs(self, put: Callable) -> None:
        ss = self.ss
        mode: dict[str, str] = {}
        for name in ("bin", "w/o", "r/w"):
            put(name, lambda name=name: mode.__setitem__(name, name))

        def save() -> None:
            path = self.text()
            if isinstance(self.top(), Model):
                self.top().save(self.spark, path, "overwrite")
            elif mode.pop("bin", None):
                from gridloom.session import write_bytes

                write_bytes(self.spark, path, corpora.tensor_bytes(*self.top().shape, self.top().values()))
            else:
                self.top().df.orderBy("k").write.mode("overwrite").parquet(path)

        def load() -> None:
            path = self.text()
            if isinstance(self.top(), Model):
                self.pop()
                ss.append(Model.load(self.spark, path))
            elif mode.pop("bin", None):
                shape, values = corpora.tensor_from_bytes(bytes(self.spark.read.format("binaryFile").load(path).first()["content"]))
                self.pop()
                ss.append(self.tensor(values, shape, 4))
            else:
                t = self.pop()
                ss.append(Tensor(self.spark.read.parquet(path), t.shape, t.rank))

        put("save", save)
        put("load", load)

        def picture() -> None:
            from gridloom.session import write_bytes

            path, t = self.text(), self.pop()
            v = t.values().reshape(t.shape)
            sd = v.std()
            grey = np.clip((v - v.mean()) * 64 / (sd if sd > 0 else 1.0), 0, 255)
            n, h, wide, c = v.shape
            across = min(10, n)
            page = np.zeros((-(-n // across) * h, across * wide, 3))
            for s in range(n):
                y, x = s // across * h, s % across * wide
                page[y : y + h, x : x + wide] = grey[s] if c == 3 else grey[s][:, :, :1]
            write_bytes(self.spark, path, summary.png(page))

        put(".png", picture)
        put(".tbinit", lambda: setattr(self, "run_", summary.Run(self.spark, self.text())))
        put(".tbstep", lambda: self.run_.at(int(self.pop())))
        put(".scalar", lambda: (lambda tag: self.run_.scalar(tag, self.pop()))(self.text()))
        put(".text", lambda: (lambda tag: self.run_.text(tag, self.text()))(self.text()))

        def grid(t: Tensor) -> DataFrame:
            _, h, wide, c = t.shape
            return t.df.select(F.expr(f"k div {h * wide * c}").alias("n"), F.expr(f"cast(k div {wide * c} % {h} as int)").alias("h"), F.expr(f"cast(k div {c} % {wide} as int)").alias("w"), (F.col("k") % c).cast("int").alias("c"), "v")

        put(".image", lambda: (lambda tag, t: self.run_.image(tag, grid(t)))(self.text(), self.pop()))
        put(".tile", lambda: (lambda tag, n, t: self.run_.tile(tag, grid(t), int(n), t.shape[1], t.shape[2]))(self.text(), self.pop(), self.pop()))
        put(".histo", lambda: (lambda tag, n, t: self.run_.histogram(tag, t.df, "v", int(n)))(self.text(), self.pop(), self.pop()))
        put(".embed", lambda: (lambda tag, t: self.run_.embed(tag, coo.to_rows(grid(t)), "n", "x"))(self.text(), self.pop()))
        put(".graph", lambda: self.run_.graph(self.top()))
