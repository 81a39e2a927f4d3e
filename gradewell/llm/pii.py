"""Personal data: rules for the plain forms, and a character-level bidirectional
LSTM with CRF transitions for the forms that rules miss.

The rules (``base_spans``) find e-mail and IP addresses, card and phone numbers.
Their spans in a bounded sample of documents are the training labels; the learner
also sees each span rewritten in usual disguises ("name at mail dot com", other
separators, numbers without the plus). The network is trained in numpy on the
driver and sent to the tasks, where each text is cut into overlapping windows.
All windows of a slice are decoded together, a character of each at a time; a
character's tag is taken from the window in which it stands farthest from an edge,
and spans are read from the whole text's tags. A span that the network adds must
stand the check of its kind once its disguise is undone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import by_bytes, id_and_text

KINDS = ("email", "ip", "card", "phone")
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "spans string, n_added long")

# The patterns of the four kinds. Where a plain search could take
# the square of a long run, the start is bound to the run's start, which is where
# the leftmost match begins.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; matches that fail their check go."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if small_parts(m.group())]
    out += [(2, *m.span()) for m in _CARD.finditer(text)
            if 13 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def undisguised(kind: int, s: str) -> bool:
    """Whether a span that the network marks is of its kind, read without disguise."""
    if kind == 0:
        s = re.sub(r"\s*[\[({]?\s*(?:@|\bat\b)\s*[\])}]?\s*", "@", s, count=1, flags=re.I)
        s = re.sub(r"\s*[\[({]?\s*(?:\.|\bdot\b)\s*[\])}]?\s*", ".", s, flags=re.I)
        return next(emails(s), None) == (0, len(s))
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    if kind == 1:
        return len(groups) == 4 and small_parts(".".join(groups))
    if kind == 2:
        return 13 <= n <= 19 and luhn("".join(groups))
    return 9 <= n <= 15 and len(groups) > 1


# ---------------------------------------------------------------- the network

# Characters with a class of their own; digits share one, and so do
# all other characters below 128 and all above.
_OWN = "abcdefghijklmnopqrstuvwxyz @.+-()[]_%/\n\""
N_CLASSES = len(_OWN) + 3


def _classes() -> np.ndarray:
    of = np.full(256, len(_OWN) + 1, np.uint8)
    for i, c in enumerate(_OWN):
        of[ord(c)] = of[ord(c.upper())] = i
    of[48:58] = len(_OWN)
    of[128:] = len(_OWN) + 2
    return of


_CLASS_OF = _classes()
TAGS = 1 + len(KINDS)
FORBIDDEN = np.array([[i != j and i > 0 and j > 0 for j in range(TAGS)] for i in range(TAGS)])


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS_OF[np.minimum(codes, 255)]


def new_weights(hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 0.3, (4 * hidden, N_CLASSES))
        w[f"x{side}"][hidden:2 * hidden] += 1.0                 # remember at first
        w[f"h{side}"] = rng.normal(0, 0.3, (4 * hidden, hidden))
        w[f"e{side}"] = rng.normal(0, 0.3, (TAGS, hidden))
    w["bias"], w["step"] = np.zeros((TAGS, 1)), np.zeros((TAGS, TAGS))
    return w


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(wx, wh, x, order):
    """One direction over (time, batch) classes; all that learning needs."""
    hidden, (steps, batch) = wh.shape[1], x.shape
    h, c = np.zeros((hidden, batch)), np.zeros((hidden, batch))
    kept = {}
    for t in order:
        z = wx[:, x[t]] + wh @ h
        a, g = _sigmoid(z[:3 * hidden]), np.tanh(z[3 * hidden:])
        i, f, o = a[:hidden], a[hidden:2 * hidden], a[2 * hidden:]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        kept[t] = (h, before, i, f, o, g, tc)
        h = o * tc
        kept[t] += (h,)
    return kept


def _run_back(wh, kept, dh_out, order, x, onehot):
    hidden, batch = wh.shape[1], x.shape[1]
    dx, dwh = np.zeros((4 * hidden, N_CLASSES)), np.zeros_like(wh)
    dh, dc = np.zeros((hidden, batch)), np.zeros((hidden, batch))
    for t in reversed(order):
        h0, c0, i, f, o, g, tc, _ = kept[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
        dwh += dz @ h0.T
        dx += dz @ onehot[x[t]]
        dh, dc = wh.T @ dz, dc * f
    return dx, dwh


def _logsum(a, axis):
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def loss_and_gradient(w: dict, x: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood of the tags, and its gradient. x, tags: (time, batch)."""
    steps, batch = x.shape
    order = list(range(steps))
    onehot = np.eye(N_CLASSES)
    fwd, bwd = _run(w["xf"], w["hf"], x, order), _run(w["xb"], w["hb"], x, order[::-1])
    e = np.stack([w["ef"] @ fwd[t][-1] + w["eb"] @ bwd[t][-1] + w["bias"] for t in order])
    move = np.where(FORBIDDEN, -30.0, w["step"])[:, :, None]
    a, b = [e[0]], [np.zeros((TAGS, batch))]
    for t in order[1:]:
        a.append(_logsum(a[-1][:, None] + move, 0) + e[t])
    for t in order[:0:-1]:
        b.append(_logsum(move + (e[t] + b[-1])[None], 1))
    b = b[::-1]
    total = _logsum(a[-1], 0)
    columns = np.arange(batch)
    gold = sum(e[t][tags[t], columns] for t in order)
    gold = gold + sum(move[tags[t - 1], tags[t], 0] for t in order[1:])
    grad = {}
    de = np.stack([np.exp(a[t] + b[t] - total) for t in order])
    for t in order:
        de[t][tags[t], columns] -= 1
    de /= batch
    dstep = np.zeros((TAGS, TAGS))
    for t in order[1:]:
        dstep += np.exp(a[t - 1][:, None] + move + (e[t] + b[t])[None] - total).sum(2)
        np.subtract.at(dstep, (tags[t - 1], tags[t]), 1)
    grad["step"] = np.where(FORBIDDEN, 0, dstep / batch)
    grad["bias"] = de.sum((0, 2))[:, None]
    for side, kept, way in (("f", fwd, order), ("b", bwd, order[::-1])):
        grad[f"e{side}"] = sum(de[t] @ kept[t][-1].T for t in order)
        dh = {t: w[f"e{side}"].T @ de[t] for t in order}
        grad[f"x{side}"], grad[f"h{side}"] = _run_back(w[f"h{side}"], kept, dh, way, x, onehot)
    return float((total - gold).mean()), grad


def train(windows: list[tuple[np.ndarray, np.ndarray]], hidden: int = 8, rounds: int = 320, batch: int = 96,
          rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray] | None:
    """Weights fitted by Adam to (classes, tags) windows of one length."""
    if not any(t.any() for _, t in windows):
        return None
    rng = np.random.default_rng(seed)
    w = new_weights(hidden, rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    x, y = np.stack([a for a, _ in windows]).T, np.stack([t for _, t in windows]).T
    for n in range(1, rounds + 1):
        pick = rng.choice(x.shape[1], min(batch, x.shape[1]), replace=False)
        _, grad = loss_and_gradient(w, x[:, pick], y[:, pick])
        step = rate * min(1.0, n / 20) * (1 - 0.9 * n / rounds)
        for k, g in grad.items():
            g = np.clip(g, -5, 5)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] -= step * (m[k] / (1 - 0.9 ** n)) / (np.sqrt(v[k] / (1 - 0.99 ** n)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


# ------------------------------------------------------------ decoding windows

def decode(w: dict, windows: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of each window. The windows go longest first, so that those still
    running at a step are the first ones; none is padded."""
    if not windows:
        return []
    lengths = np.array([len(x) for x in windows])
    by_length = np.argsort(-lengths, kind="stable")
    steps, batch = int(lengths.max()), len(windows)
    running = np.searchsorted(-lengths[by_length], -np.arange(1, steps + 1), side="right")
    x = np.zeros((steps, batch), np.uint8)
    for column, i in enumerate(by_length):
        x[:lengths[i], column] = windows[i]
    hidden = w["hf"].shape[1]
    gates = 3 * hidden
    e = np.empty((steps, TAGS, batch), np.float32)
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        half = np.ones((4 * hidden, 1), np.float32)
        half[:gates] = 0.5                                   # sigmoid by way of tanh
        wx, wh, we = w[f"x{side}"] * half, np.ascontiguousarray(w[f"h{side}"] * half), w[f"e{side}"]
        h, c = np.zeros((hidden, batch), np.float32), np.zeros((hidden, batch), np.float32)
        for t in order:
            n = running[t]
            z = wx.take(x[t, :n], axis=1)
            z += wh @ h[:, :n]
            np.tanh(z, out=z)
            a = z[:gates]
            a *= 0.5
            a += 0.5
            cell = c[:, :n]
            cell *= a[hidden:2 * hidden]
            z[gates:] *= a[:hidden]
            cell += z[gates:]
            np.multiply(np.tanh(cell), a[2 * hidden:], out=h[:, :n])
            if side == "f":
                np.add(we @ h[:, :n], w["bias"], out=e[t, :, :n])
            else:
                e[t, :, :n] += we @ h[:, :n]
    move = w["step"]
    stay, enter, leave = move.diagonal()[1:, None], move[0, 1:, None], move[1:, 0, None]
    score = e[0].copy()
    came_from = np.zeros((steps, TAGS, batch), np.uint8)      # the tag before
    kinds = np.arange(1, TAGS, dtype=np.uint8)[:, None]
    for t in range(1, steps):
        n = running[t]
        s = score[:, :n]
        out = np.concatenate([s[:1] + move[0, 0], s[1:] + leave])
        best = out.argmax(0)
        staying, entering = s[1:] + stay, s[:1] + enter
        came_from[t, 0, :n] = best
        came_from[t, 1:, :n] = np.where(staying >= entering, kinds, 0)
        s[0] = out.max(0)
        np.maximum(staying, entering, out=s[1:])
        s += e[t, :, :n]
    tags = np.zeros((steps, batch), np.uint8)
    now, columns = score.argmax(0), np.arange(batch)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        tags[t, :n] = now[:n]
        now[:n] = came_from[t, now[:n], columns[:n]]
    out: list = [None] * batch
    for column, i in enumerate(by_length):
        out[i] = tags[:lengths[i], column]
    return out


def window_bounds(length: int, size: int, margin: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of the windows of a text: a window reads start..end
    and decides first..last, which meet in the middle of two windows' overlap."""
    out, core = [], size - 2 * margin
    first = 0
    while first < length or not out:
        last = min(first + core, length)
        if length - last <= margin:
            last = length
        out.append((max(0, first - margin), min(length, last + margin), first, last))
        first = last
        if last >= length:
            break
    return out


def tag_texts(w: dict, texts: list[str], size: int, margin: int) -> list[np.ndarray]:
    """Tags of whole texts, put together from their windows."""
    windows, places = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        x = encode(text)
        for start, end, first, last in window_bounds(len(x), size, margin):
            windows.append(x[start:end])
            places.append((i, first - start, last - start))
    parts: list[list] = [[] for _ in texts]
    for (i, a, b), tags in zip(places, decode(w, windows)):
        parts[i].append(tags[a:b])
    return [np.concatenate(p) if p else np.zeros(0, np.uint8) for p in parts]


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the tags that touch no base span and stand their kind's check."""
    if not tags.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]]).astype(np.int16)))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        inner = text[a:b]
        trimmed = inner.strip(" \n\t.,;:")
        a += len(inner) - len(inner.lstrip(" \n\t.,;:"))
        b = a + len(trimmed)
        if trimmed and undisguised(kind, trimmed) and not any(s < b and a < e for _, s, e in base):
            out.append((kind, a, b))
    return out


# ------------------------------------------------------------------- learning

def disguised(kind: int, s: str, rng: np.random.Generator) -> str:
    """A span as people write it to keep it from plain rules."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == 0:
        dot = pick(" dot ", "[.]", " . ", " [dot] ")
        name, _, domain = s.partition("@")
        return name + pick(" at ", " (at) ", " [at] ", "[at]", " @ ") + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", pick("[.]", " . ", "(.)", " dot "))
    d = digits(s)
    if kind == 2:
        return pick(".", "_", "/", " - ").join(d[i:i + 4] for i in range(0, len(d), 4))
    sign = pick("", "00", "(+")
    body = s.lstrip("+") if not sign == "00" else s.lstrip("+").replace(" ", "-")
    return sign + (body.replace(" ", ") ", 1) if sign == "(+" else body)


def training_windows(texts: list[str], size: int = 72,
                     per_text: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled windows: around the first ``per_text`` base spans of each text as
    they are and disguised, and two from anywhere in the text."""
    out = []
    for text in texts:
        rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        base = base_spans(text)
        flat = np.zeros(len(text), np.uint8)
        for kind, a, b in base:
            flat[a:b] = kind + 1
        wanted = [(k, a, b, d) for k, a, b in base[:per_text] for d in (False, True)]
        for kind, a, b, change in wanted:
            middle = disguised(kind, text[a:b], rng) if change else text[a:b]
            shift = int(rng.integers(0, max(1, size - len(middle))))
            left, right = text[max(0, a - shift):a], text[b:b + size]
            tags = np.concatenate([flat[max(0, a - shift):a], np.full(len(middle), kind + 1, np.uint8),
                                   flat[b:b + size]])
            _append(out, left + middle + right, tags, size)
        for _ in range(2):
            a = int(rng.integers(0, max(1, len(text) - size)))
            _append(out, text[a:a + size], flat[a:a + size], size)
    return out


def _append(out: list, text: str, tags: np.ndarray, size: int) -> None:
    """A window of exactly ``size`` characters, filled up with line ends."""
    text, tags = text[:size], tags[:size]
    missing = size - len(text)
    out.append((encode(text + "\n" * missing), np.concatenate([tags, np.zeros(missing, np.uint8)])))


def learn(docs: DataFrame, sample: int) -> dict | None:
    """Train on at most ``sample`` documents, chosen by a hash of the id: half of
    any, so that plain text is seen, and half of those with a sign of personal data."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            pairs = training_windows(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a, _ in pairs], pa.binary()),
                                              pa.array([t.tobytes() for _, t in pairs], pa.binary())], ["x", "tags"])

    signs = F.col("text").rlike(r"@|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]")
    windows = []
    for some in (docs.where(signs), docs):
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample // 2).select("text")
        rows = some.mapInArrow(cut, "x binary, tags binary").toArrow()
        windows += [(np.frombuffer(a, np.uint8), np.frombuffer(t, np.uint8))
                    for a, t in zip(rows["x"].to_pylist(), rows["tags"].to_pylist())]
    return train(windows) if windows else None


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1_000,
                  size: int = 512, margin: int = 48) -> DataFrame:
    """Counts and spans of personal data in each whole text.

    ``n_*`` and ``base_sha256`` tell of the rules' spans, ``spans`` lists them and
    those that the network adds (``n_added``), by kind and then start; places are
    code points, ends exclusive. Null and empty texts have no spans; a null id
    stays null; repeated rows each come back; where the sample has no span the
    rules stand alone; an empty table gives an empty result; other columns are
    not read.
    """
    data = id_and_text(docs, id_col, text_col)
    weights = learn(data, sample)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=1 << 20):
            texts = batch.column("text").to_pylist()
            tags = tag_texts(weights, texts, size, margin) if weights else [np.zeros(0, np.uint8)] * len(texts)
            rows = []
            for text, t in zip(texts, tags):
                base = base_spans(text)
                more = added_spans(text, t, base)
                rows.append((*[sum(k == i for k, _, _ in base) for i in range(len(KINDS))],
                             hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(sorted(base + more)), len(more)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                [c.split()[0] for c in SCHEMA.split(", ")])

    return data.mapInArrow(find, SCHEMA)
