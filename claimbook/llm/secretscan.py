"""Secrets in texts: fixed rules, and a convolutional network over every other candidate.

Three rules give the base findings. A candidate is a run of six or more value characters that
holds a digit or a change of case, or stands behind a colon or equals sign. The candidates
that a rule covers are the labelled findings the network learns from, the others are its
counterexamples; it sees 64 characters: the context before, the value, and what follows. What
it then finds is added to the base findings, which stay as they are.

Half of the training findings are put into the context of a counterexample, and their
characters shuffled within their kind, so that the network has to know the look of a value and
not only the words before it. Its output is calibrated on values that it has not seen, and the
threshold is lowered until the wanted share of those is found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimbook.llm.tables import plus, slices, texts_of, written
from claimbook.operators.quantiles import quantile_columns

KINDS = ("assign", "access", "hex", "net")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Runs are taken whole, so a least length in the pattern drops just those that are too short.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_TELLING = re.compile(r"[0-9]|[a-z][A-Z]")
_MARK = re.compile(r"[:=]\x20*[\"']?\Z")

BEFORE, VALUE, AFTER = 24, 32, 8
WIDTH = BEFORE + VALUE + AFTER
HEAD = 20
SYMBOLS, CHANNELS, FILTERS = 128, 8, 16
# Up to so many windows are fitted in one place, more in parts of about this size.
PART, BATCH, LEAST_STEPS = 8_192, 64, 300
RECALL = 0.95
# A counterexample whose value is rated like this share of the findings, and at least so, is unsure.
ALIKE, LIKELY = 0.99, 0.2
RESULT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Findings of the rules as (start, place of the kind in KINDS, end), in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    """Spans as ``kind:start:end``, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """Start and end of every candidate, and whether it stands behind a mark."""
    found = []
    for m in _RUN.finditer(text):
        s, e = m.span()
        marked = s > 0 and text[s - 1] in ":=\"' " and _MARK.search(text, max(0, s - 16), s) is not None
        if marked or _TELLING.search(text, s, e):
            found.append((s, e, marked))
    return found


def window(text: str, start: int, end: int) -> bytes:
    """The 64 characters the network sees of a candidate; of a long value its head and tail."""
    value = text[start:end] if end - start <= VALUE else text[start : start + HEAD] + text[end - VALUE + HEAD : end]
    parts = (text[max(0, start - BEFORE) : start], value, text[end : end + AFTER])
    before, value, after = (p.encode("ascii", "replace") for p in parts)
    return before.rjust(BEFORE, b"\0") + value.ljust(VALUE, b"\0") + after.ljust(AFTER, b"\0")


@dataclass
class Network:
    """Weights of two convolutions and a linear output over pooled regions; calibration; thresholds."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        inner = CHANNELS + 1
        return Network({
            "symbols": rng.normal(0, 0.3, (SYMBOLS, CHANNELS)),
            "first": rng.normal(0, (2 / (5 * inner)) ** 0.5, (5 * inner, FILTERS)), "first_0": np.zeros(FILTERS),
            "second": rng.normal(0, (2 / (3 * FILTERS)) ** 0.5, (3 * FILTERS, FILTERS)), "second_0": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 3 * FILTERS), "out_0": np.zeros(1)})

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Raw output for rows of character codes, and what a step back needs."""
        w = self.weights
        inside = np.zeros((WIDTH, 1))
        inside[BEFORE : BEFORE + VALUE] = 1.0
        x = np.concatenate([w["symbols"][codes], np.broadcast_to(inside, (len(codes), WIDTH, 1))], 2)
        x1 = np.concatenate([x[:, k : WIDTH - 4 + k] for k in range(5)], 2)
        h1 = np.maximum(x1 @ w["first"] + w["first_0"], 0)
        n1 = h1.shape[1]
        x2 = np.concatenate([h1[:, k : n1 - 2 + k] for k in range(3)], 2)
        h2 = np.maximum(x2 @ w["second"] + w["second_0"], 0)
        left, mid = h2[:, : BEFORE - 3], h2[:, BEFORE - 3 : BEFORE - 3 + VALUE]
        pooled = np.concatenate([left.max(1), mid.max(1), mid.mean(1)], 1)
        return pooled @ w["out"] + w["out_0"], (codes, x1, h1, x2, h2, left.argmax(1), mid.argmax(1), pooled)

    def backward(self, kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights from the loss's slope in the raw output."""
        codes, x1, h1, x2, h2, at_left, at_mid, pooled = kept
        w, n, inner = self.weights, len(codes), CHANNELS + 1
        g = {"out": pooled.T @ slope, "out_0": slope.sum(keepdims=True)}
        d_pool = slope[:, None] * w["out"]
        d2, row, col = np.zeros_like(h2), np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        np.add.at(d2, (row, at_left, col), d_pool[:, :FILTERS])
        np.add.at(d2, (row, at_mid + BEFORE - 3, col), d_pool[:, FILTERS : 2 * FILTERS])
        d2[:, BEFORE - 3 : BEFORE - 3 + VALUE] += d_pool[:, None, 2 * FILTERS :] / VALUE
        d2 *= h2 > 0
        g["second"] = np.tensordot(x2, d2, ((0, 1), (0, 1)))
        g["second_0"] = d2.sum((0, 1))
        dx2, d1 = d2 @ w["second"].T, np.zeros_like(h1)
        for k in range(3):
            d1[:, k : h1.shape[1] - 2 + k] += dx2[:, :, k * FILTERS : (k + 1) * FILTERS]
        d1 *= h1 > 0
        g["first"] = np.tensordot(x1, d1, ((0, 1), (0, 1)))
        g["first_0"] = d1.sum((0, 1))
        dx1, dx = d1 @ w["first"].T, np.zeros((n, WIDTH, inner))
        for k in range(5):
            dx[:, k : WIDTH - 4 + k] += dx1[:, :, k * inner : (k + 1) * inner]
        g["symbols"] = np.zeros_like(w["symbols"])
        np.add.at(g["symbols"], codes, dx[:, :, :CHANNELS])
        return g

    def probabilities(self, codes: np.ndarray, step: int = 2_048) -> np.ndarray:
        """Calibrated probability of every window."""
        raw = [self.forward(codes[i : i + step])[0] for i in range(0, len(codes), step)]
        z = self.slope * np.concatenate([*raw, np.zeros(0)]) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))

    def accepts(self, codes: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Windows whose probability reaches the threshold of their class."""
        return self.probabilities(codes) >= np.asarray(self.thresholds)[marked.astype(int)]


def codes_of(windows: bytes) -> np.ndarray:
    return np.frombuffer(windows, np.uint8).reshape(-1, WIDTH) & (SYMBOLS - 1)


def _recast(codes: np.ndarray, contexts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Findings whose value characters are drawn anew within letters, capitals and digits, in other contexts."""
    out = codes.copy()
    value = out[:, BEFORE : BEFORE + VALUE]
    for low, high in ((48, 57), (65, 90), (97, 122)):
        for row in value:
            spots = np.flatnonzero((row >= low) & (row <= high))
            row[spots] = rng.permutation(row[spots])
    if len(contexts):
        other = contexts[rng.integers(0, len(contexts), len(out))]
        out[:, :BEFORE], out[:, BEFORE + VALUE :] = other[:, :BEFORE], other[:, BEFORE + VALUE :]
    return out


def _newton(loss: Callable, slopes: Callable) -> tuple[float, float]:
    """Slope and shift with the least loss, by Newton steps that are halved until the loss falls."""
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        gradient, hessian = slopes(beta)
        step = np.linalg.solve(hessian + 1e-6 * np.eye(2), gradient)
        sizes = 0.5 ** np.arange(21)
        now, *then = loss([beta, *[beta - size * step for size in sizes]])
        size = next((x for x, v in zip(sizes, then, strict=True) if v <= now), sizes[-1])
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _softened(good: int, bad: int) -> tuple[float, float]:
    """Targets of findings and counterexamples in the calibration."""
    return (good + 1) / (good + 2), 1 / (bad + 2)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through raw outputs, by Newton steps on softened labels."""
    target = np.where(y == 1, *_softened(y.sum(), (1 - y).sum()))
    x = np.column_stack([z, np.ones_like(z)])

    def loss(betas: list[np.ndarray]) -> list[float]:
        return [float(np.sum(np.logaddexp(0, x @ b) - target * (x @ b))) for b in betas]

    def slopes(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        return x.T @ (p - target), (x * (p * (1 - p))[:, None]).T @ x

    return _newton(loss, slopes)


def _calibrated_rows(rated: DataFrame, good: int, bad: int) -> tuple[float, float]:
    """The same curve through the rows of ``z, found``, from sums over all of them."""
    high, low = _softened(good, bad)
    target = F.when(F.col("found"), F.lit(high)).otherwise(F.lit(low))

    def loss(betas: list[np.ndarray]) -> list[float]:
        eta = [F.col("z") * float(b[0]) + float(b[1]) for b in betas]
        each = [F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e))) - target * e for e in eta]
        return list(rated.agg(*[F.sum(e).alias(f"l{i}") for i, e in enumerate(each)]).first())

    def slopes(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = F.greatest(F.least(F.col("z") * float(beta[0]) + float(beta[1]), F.lit(30.0)), F.lit(-30.0))
        p, z = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)), F.col("z")
        off, w = p - target, p * (F.lit(1.0) - p)
        g0, g1, a, b, c = rated.agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate((off * z, off, w * z * z, w * z, w))]).first()
        return np.array([g0, g1]), np.array([[a, b], [b, c]])

    return _newton(loss, slopes)


def _reached(p: np.ndarray, recall: float) -> float:
    """The highest value that the wanted share of ``p`` reaches."""
    return float(np.sort(p)[int(np.floor((1.0 - recall) * len(p)))])


def _pass(net: Network, moments: dict, t: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> int:
    """One pass of Adam over the rows in random order; the number of steps made so far."""
    order = rng.permutation(len(x))
    for at in range(0, len(x), BATCH):
        pick, t = order[at : at + BATCH], t + 1
        z, kept = net.forward(x[pick])
        slope = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[pick]) / len(pick)
        for name, g in net.backward(kept, slope).items():
            m, v = moments[name]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            net.weights[name] -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return t


def _fitted(x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, seed: int) -> Network:
    """Network fitted by Adam on rows of both labels, each label having half the weight."""
    net, good = Network.fresh(seed), y.sum()
    weight = np.where(y == 1, len(y) / (2 * good), len(y) / (2 * (len(y) - good)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    t = 0
    steps = max(LEAST_STEPS, epochs * len(x) // BATCH)
    while t < steps:
        t = _pass(net, moments, t, x, y, weight, rng)
    return net


def _unpacked(state: np.ndarray) -> tuple[Network, dict]:
    """Network and moments from one row of numbers."""
    net, at, moments = Network.fresh(0), 0, {}
    for name, w in net.weights.items():
        three = state[at : at + 3 * w.size].reshape(3, *w.shape).copy()
        net.weights[name], moments[name], at = three[0], (three[1], three[2]), at + 3 * w.size
    return net, moments


def _packed(net: Network, moments: dict) -> np.ndarray:
    return np.concatenate([np.stack([w, *moments[name]]).ravel() for name, w in net.weights.items()])


def _fitted_apart(rows: DataFrame, parts: int, good: int, bad: int, epochs: int, seed: int, values: bool) -> Network:
    """Network fitted on all rows with ``use`` of ``part, seen, found, use``, in rounds of one pass each.

    In a round every part goes on from the common weights and moments with a pass over its own
    rows, and their means, weighted by rows, are the next common ones. With ``values`` only the
    values are seen; else the findings are also seen recast into the part's counterexamples.
    """
    total = good + bad + (0 if values else good)
    of_good, of_bad = total / (2 * (total - bad)), total / (2 * bad)
    fresh = Network.fresh(seed)
    state = _packed(fresh, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in fresh.weights.items()})
    rounds = max(epochs, -(-LEAST_STEPS * BATCH * parts // total))
    for done in range(rounds):

        def go(group: pa.Table, *, state: np.ndarray = state, done: int = done) -> pa.Table:
            part = group["part"][0].as_py()
            group = group.sort_by([("seen", "ascending"), ("found", "ascending")])
            codes = codes_of(b"".join(group["seen"].to_pylist()))
            found, use = (group[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("found", "use"))
            x, y = codes[use], found[use].astype(int)
            if values:
                x = _alone(x)
            else:
                again = _recast(x[y == 1], codes[~found], np.random.default_rng([seed, part]))
                x, y = np.concatenate([x, again]), np.concatenate([y, np.ones(len(again), int)])
            net, moments = _unpacked(state)
            _pass(net, moments, done * -(-len(x) // BATCH), x, y, np.where(y == 1, of_good, of_bad),
                  np.random.default_rng([seed, part, done]))
            return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([len(x)], pa.int64()),
                             "state": pa.array([_packed(net, moments).tobytes()], pa.binary())})

        said = sorted(rows.groupBy("part").applyInArrow(go, "part long, n long, state binary").collect())
        share = np.array([r["n"] for r in said]) / sum(r["n"] for r in said)
        state = sum(w * np.frombuffer(bytes(r["state"])) for w, r in zip(share, said, strict=True))
    return _unpacked(state)[0]


def _alone(codes: np.ndarray) -> np.ndarray:
    """Values without what stands around them."""
    out = np.zeros_like(codes)
    out[:, BEFORE : BEFORE + VALUE] = codes[:, BEFORE : BEFORE + VALUE]
    return out


def train(codes: np.ndarray, label: np.ndarray, marked: np.ndarray, aside: np.ndarray,
          recall: float = RECALL, epochs: int = 8, seed: int = 3) -> Network | None:
    """Network fitted on the rows not set aside, calibrated on the others; None without both labels in each.

    Counterexamples are only candidates without a rule, so some are secrets. Two networks, each
    fitted on half of the values alone, rate the other half; counterexamples rated as high as 99 %
    of the findings are unsure: neither fitted nor calibrated on, they only lend contexts. The
    threshold of a class (behind a mark or not) is a probability of one half, or lower where the
    wanted share of the findings set aside is only reached below that: of its own findings if
    there are 20 at least, else of all.
    """
    rng = np.random.default_rng(seed)

    def both(part: np.ndarray) -> bool:
        return len(np.unique(label[part])) == 2

    if not (both(~aside) and both(aside)):
        return None
    half, values, likely = rng.random(len(codes)) < 0.5, _alone(codes), np.zeros(len(codes))
    if not (both(half) and both(~half)):
        return None
    for part in (half, ~half):
        likely[part] = _fitted(values[~part], label[~part], 4, rng, seed).probabilities(values[part])
    unsure = (label == 0) & (likely >= max(LIKELY, _reached(likely[label == 1], ALIKE)))
    fit, held = ~aside & ~unsure, aside & ~unsure
    if not (both(fit) and both(held)):
        return None
    good, bad = codes[fit & (label == 1)], codes[fit & (label == 0)]
    x = np.concatenate([good, _recast(good, codes[~aside & (label == 0)], rng), bad])
    net = _fitted(x, np.repeat([1, 0], [2 * len(good), len(bad)]), epochs, rng, seed)
    found, of_class = label[held], marked[held].astype(bool)
    raw = np.concatenate([net.forward(codes[held][i : i + 2048])[0] for i in range(0, int(held.sum()), 2048)])
    net.slope, net.shift = _calibrated(raw, found.astype(float))
    p = net.probabilities(codes[held])
    chosen = []
    for c in (False, True):
        own = p[(found == 1) & (of_class == c)]
        chosen.append(min(0.5, _reached(own if len(own) >= 20 else p[found == 1], recall)))
    net.thresholds = (chosen[0], chosen[1])
    return net


def _prepared(rows: DataFrame, text: str) -> DataFrame:
    """Rules and candidates of every text: one pass over the texts, written."""
    position = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if i != position]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base", "places", "windows")}
            for body in texts_of(batch.column(position)):
                base = base_spans(body)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(b[1] == k for b in base))
                out["base"].append(np.array(base, "<i8").tobytes())
                places, windows, i, reach = [], [], 0, 0
                for s, e, marked in candidates(body):
                    while i < len(base) and base[i][0] < e:
                        reach, i = max(reach, base[i][2]), i + 1
                    places.append((s, e, marked, reach > s))
                    windows.append(window(body, s, e))
                out["places"].append(np.array(places, "<i8").tobytes())
                out["windows"].append(b"".join(windows))
            inner = [batch.schema.field(i) for i in kept]
            row = pa.StructArray.from_arrays([batch.column(i) for i in kept], fields=inner) if inner else pa.nulls(batch.num_rows, pa.struct([]))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays(
                [row, *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["row", *out])

    ddl = "n_assign long, n_access long, n_hex long, base binary, places binary, windows binary"
    schema = T.StructType([T.StructField("row", rows.drop(text).schema), *T.StructType.fromDDL(ddl).fields])
    return written(rows.mapInArrow(prepare, schema))


def _rates(nets: tuple[Network, Network], values: bool, calibrated: bool):
    """``seen, marked, found, half`` with the output for each window of the network of its half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_048):
            codes = codes_of(b"".join(batch.column(0).to_pylist()))
            codes = _alone(codes) if values else codes
            half = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            out = np.zeros(len(codes))
            for h in (False, True):
                if (half == h).any():
                    net, own = nets[h], codes[half == h]
                    out[half == h] = net.probabilities(own) if calibrated else net.forward(own)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "z"])

    return run


def _reached_rows(rows: DataFrame, n: int, recall: float) -> float:
    """The highest ``z`` of ``n`` rows that the wanted share reaches, less a margin for rounding."""
    at = min(1.0, int(np.floor((1.0 - recall) * n)) / max(1, n - 1))
    return float(quantile_columns(rows, "z", {"q": at}).first()["q"]) - 1e-9


def _train_rows(each: DataFrame, n: int, recall: float, seed: int, part: int, epochs: int = 8) -> Network | None:
    """What ``train`` does, on all rows of a table of any size: parts fit, sums calibrate, exact ranks set thresholds."""
    parts = -(-n // part)
    rows = written(each.withColumn("part", F.pmod(F.xxhash64("seen", "marked", F.lit(seed)), F.lit(parts))).withColumn(
        "half", F.pmod(F.xxhash64("seen", "marked", "found", F.lit(seed + 1)), F.lit(2)) == 0))

    def counted(df: DataFrame, by: str) -> dict[tuple[bool, bool], int]:
        count = {(r[by], r["found"]): r["count"] for r in df.groupBy(by, "found").count().collect()}
        return {(b, f): count.get((b, f), 0) for b in (False, True) for f in (False, True)}

    halves = counted(rows, "half")
    if not (all(counted(rows, "aside").values()) and all(halves.values())):
        return None
    nets = tuple(_fitted_apart(rows.filter(F.col("half") != h).withColumn("use", F.lit(True)), parts, halves[not h, True],
                               halves[not h, False], 4, seed, True) for h in (False, True))
    schema = plus(rows.select("seen", "marked", "found", "half", "aside", "part").schema, "z double")
    likely = written(rows.select("seen", "marked", "found", "half", "aside", "part").mapInArrow(_rates(nets, True, True), schema))
    level = max(LIKELY, _reached_rows(likely.filter("found"), halves[False, True] + halves[True, True], ALIKE))
    sure = likely.withColumn("use", F.col("found") | (F.col("z") < level)).drop("z")
    held = counted(sure.filter("use"), "aside")
    if not all(held.values()):
        return None
    fitted = sure.filter(~F.col("aside"))
    net = _fitted_apart(fitted, parts, held[False, True], held[False, False], epochs, seed, False)
    kept = sure.filter("aside and use").select("seen", "marked", "found", "half")
    raw = written(kept.mapInArrow(_rates((net, net), False, False), plus(kept.schema, "z double")).drop("seen"))
    net.slope, net.shift = _calibrated_rows(raw, held[True, True], held[True, False])
    found = raw.filter("found").withColumn("z", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(
        F.col("z") * net.slope + net.shift, F.lit(50.0)), F.lit(-50.0)))))
    chosen = []
    for c in (False, True):
        own = found.filter(F.col("marked") == c)
        few = (size := own.count()) < 20
        chosen.append(min(0.5, _reached_rows(found if few else own, held[True, True] if few else size, recall)))
    net.thresholds = (chosen[0], chosen[1])
    return net


def fit(prepared: DataFrame, recall: float = RECALL, seed: int = 3, part: int = PART) -> Network | None:
    """Network from all distinct findings and counterexamples; more than ``part`` are fitted in parts of about that size."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                facts = np.frombuffer(places, "<i8").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([windows[i : i + WIDTH] for i in range(0, len(windows), WIDTH)], pa.binary()),
                     pa.array(facts[:, 2] == 1), pa.array(facts[:, 3] == 1)], ["seen", "marked", "found"])

    each = prepared.select("places", "windows").mapInArrow(unfold, "seen binary, marked boolean, found boolean").distinct()
    value = F.substring("seen", BEFORE + 1, VALUE)
    each = written(each.withColumn("aside", F.pmod(F.xxhash64(value), F.lit(5)) == 0))
    n = each.count()
    if n > part:
        return _train_rows(each, n, recall, seed, part)
    picked = each.orderBy(F.desc("found"), F.xxhash64("seen", F.lit(seed)), "seen", "marked").toArrow()
    if picked.num_rows == 0:
        return None
    codes = codes_of(b"".join(picked["seen"].to_pylist()))
    label, marked, aside = (np.array(picked[c].to_pylist(), bool) for c in ("found", "marked", "aside"))
    return train(codes, label.astype(int), marked, aside, recall, seed=seed)


def scan(docs: DataFrame, text: str = "text", recall: float = RECALL, seed: int = 3, part: int = PART) -> DataFrame:
    """The rows, less their text, with the secrets found in it.

    ``n_assign, n_access, n_hex`` count the findings of the rules, ``base_sha256`` is the digest
    of their spans, and ``spans`` lists these and the candidates that the network accepts and no
    rule covers (kind ``net``), by start and kind; places are code points, ends exclusive.

    Null texts count as empty: no findings, and the digest of nothing. Whole texts are scanned,
    however long. Repeated rows each get their findings. If the table holds no finding or no
    counterexample among the values set aside and the others, nothing can be learned and only
    the rules speak. An empty table gives no rows. Existing columns with the names of the
    results are replaced, all others stay.
    """
    rows = docs.drop(*[c for c in RESULT if c != text])
    prepared = _prepared(rows, text)
    net = fit(prepared, recall, seed, part)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            bases, placed, windows = (batch.column(c).to_pylist() for c in ("base", "places", "windows"))
            facts = np.frombuffer(b"".join(placed), "<i8").reshape(-1, 4)
            taken = np.zeros(len(facts), bool)
            if net is not None and len(facts):
                open_ = np.flatnonzero(facts[:, 3] == 0)
                codes, back = np.unique(codes_of(b"".join(windows))[open_], axis=0, return_inverse=True)
                p = net.probabilities(codes)[back.ravel()]
                taken[open_] = p >= np.asarray(net.thresholds)[facts[open_, 2]]
            digests, spans, at = [], [], 0
            for base, places in zip(bases, placed, strict=True):
                found = [tuple(r) for r in np.frombuffer(base, "<i8").reshape(-1, 3).tolist()]
                n = len(places) // 32
                more = [(int(s), 3, int(e)) for s, e in facts[at : at + n][taken[at : at + n], :2]]
                at += n
                digests.append(sha256(shown(found).encode()).hexdigest())
                spans.append(shown(sorted(found + more)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "n_assign", "n_access", "n_hex")], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["row", *RESULT])

    schema = plus(prepared.select("row", "n_assign", "n_access", "n_hex").schema, "base_sha256 string, spans string")
    return prepared.mapInArrow(report, schema).select("row.*", *RESULT)
