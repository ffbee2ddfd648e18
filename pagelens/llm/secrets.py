"""Secrets in text: fixed rules, and a character convolutional network over every candidate.

A candidate is nominated by its look or by its context: a run of 16 or more characters of keys
and tokens that holds a letter and a digit, or any run of 8 or more characters other than blanks
behind a colon, an equals sign or a word for credentials. What the base rules leave over of a
candidate is one too, if 8 or more characters remain.
The network reads a candidate with 24 characters before and 8 after; longer candidates are
read in pieces of 64 characters, each with its surroundings, and the highest score counts.
It is a small network in numpy (character vectors, one convolution, pooling over the
candidate and over what stands before it, one hidden layer), so a task scores a batch of
candidates with a few matrix products.

It is trained on labelled findings: candidates of a sample of about ``TRAINING_DOCS``
documents, labelled by the fixed rules (at most ``FINDINGS`` of either label), and
``GENERATED`` findings each of other kinds of credentials and of harmless look-alikes, told by
their look or by what stands before them. Scores are calibrated on
findings that were set aside; the threshold is a probability of one half, or the highest one
below it that keeps ``RECALL`` of the secrets among them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.toxicity import logistic
from pagelens.llm.words import place_of, small_batches, written

TRAINING_DOCS = 20_000
FINDINGS = 2_000
GENERATED = 4_000
RECALL = 0.98
BEFORE, PIECE, AFTER = 24, 64, 8
VECTOR, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
KINDS = ("assign", "access", "hex", "network")
MASK = "[secret]"

# The base rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

# Matches of the access and hex rules lie inside such runs.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
# What stands behind such marks and words is a candidate whatever it is made of.
CREDENTIAL_WORDS = "bearer|basic|pass(?:word|wd|phrase)?|pwd|secret|token|auth|authorization|credentials?|key"
CONTEXT = re.compile(rf"""(?:[:=]|\b(?:{CREDENTIAL_WORDS})\b)["']?\x20*[:=]?\x20*["']?([^\s"']\S{{7,}})""", re.IGNORECASE | re.ASCII)
LEAST = 8
_CLOSING = "\"'.,;:)]}>"
# Pieces scored together.
SCORED_PIECES = 4096


def nominated(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates by context that overlap none of the runs; runs in order."""
    found, k = [], 0
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        end = start + len(m[1].rstrip(_CLOSING))
        while k < len(runs) and runs[k][1] <= start:
            k += 1
        if end - start >= LEAST and (k == len(runs) or end <= runs[k][0]):
            found.append((start, end))
    return found


def left_over(candidates: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the base spans leave of the candidates; both in order."""
    out, first = [], 0
    for start, end in candidates:
        # Spans of several kinds may overlap, so an earlier one can reach further than a later one.
        while first < len(base) and base[first][2] <= start:
            first += 1
        at, k = start, first
        while k < len(base) and base[k][1] < end:
            if base[k][1] - at >= LEAST:
                out.append((at, base[k][1]))
            at = max(at, base[k][2])
            k += 1
        if at == start or end - at >= LEAST:
            out.append((at, end))
    return out


def findings(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans of the base rules by start and kind, and the candidates in order."""
    base, candidates = [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                base.append(("assign", *m.span()))
    for run in RUN.finditer(text):
        word, at = run[0], run.start()
        for kind, rule, least in (("access", ACCESS, ACCESS_LENGTH), ("hex", HEX, HEX_LENGTH)):
            if kind == "hex" or "AKIA" in word:
                base += [(kind, at + m.start(), at + m.end()) for m in rule.finditer(word) if len(m[0]) >= least]
        word = word.rstrip(".")
        if len(word) >= 16 and _LETTER.search(word) and _DIGIT.search(word):
            candidates.append((at, at + len(word)))
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return base, sorted(candidates + nominated(text, candidates))


def _codes(text: str) -> np.ndarray:
    """1 to 128 for ASCII, 129 for anything else; 0 is left for places outside the text."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.int16) + 1


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """The candidate's pieces with their surroundings."""
    found = []
    for at in range(start, end, PIECE):
        row = np.zeros(BEFORE + PIECE + AFTER, dtype=np.int16)
        stop = min(at + PIECE, end)
        left, right = text[max(0, at - BEFORE) : at], text[stop : stop + AFTER]
        row[BEFORE - len(left) : BEFORE] = _codes(left)
        row[BEFORE : BEFORE + stop - at] = _codes(text[at:stop])
        row[BEFORE + PIECE : BEFORE + PIECE + len(right)] = _codes(right)
        found.append(row)
    return found


class Network:
    """Character vectors, convolution, pooling, one hidden layer, one score."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def drawn(*shape):
            return (rng.standard_normal(shape) / np.sqrt(np.prod(shape[:-1]))).astype(np.float32)

        self.w = {
            "vectors": (rng.standard_normal((130, VECTOR)) * 0.5).astype(np.float32), "conv": drawn(WIDTH * VECTOR, FILTERS),
            "conv0": np.zeros(FILTERS, np.float32), "hidden": drawn(3 * FILTERS, HIDDEN), "hidden0": np.zeros(HIDDEN, np.float32),
            "out": drawn(HIDDEN, 1), "out0": np.zeros(1, np.float32),
        }
        self.w["vectors"][0] = 0

    def _forward(self, x: np.ndarray) -> dict:
        w, n = self.w, len(x)
        seen = w["vectors"][x]
        slices = np.lib.stride_tricks.sliding_window_view(seen, WIDTH, axis=1)  # n, places, VECTOR, WIDTH
        patches = slices.transpose(0, 1, 3, 2).reshape(n, -1, WIDTH * VECTOR)
        conv = np.maximum(patches @ w["conv"] + w["conv0"], 0)
        inside = conv[:, BEFORE - WIDTH // 2 : BEFORE + PIECE - WIDTH // 2]
        real = (x[:, BEFORE : BEFORE + PIECE] > 0)[:, :, None]
        inside = inside * real
        before = conv[:, : BEFORE - WIDTH // 2]
        share = real.sum(axis=1)
        pooled = np.concatenate([inside.max(axis=1), inside.sum(axis=1) / np.maximum(share, 1), before.max(axis=1)], axis=1)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden0"], 0)
        return {"patches": patches, "conv": conv, "inside": inside, "before": before, "real": real, "share": share,
                "pooled": pooled, "hidden": hidden, "score": (hidden @ w["out"] + w["out0"])[:, 0]}

    def score(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 512])["score"] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def _backward(self, x: np.ndarray, f: dict, slope: np.ndarray) -> dict:
        w, n = self.w, len(x)
        g = {"out": f["hidden"].T @ slope[:, None], "out0": slope.sum(keepdims=True)}
        hidden = slope[:, None] * w["out"][:, 0] * (f["hidden"] > 0)
        g["hidden"], g["hidden0"] = f["pooled"].T @ hidden, hidden.sum(axis=0)
        top, mean, before = np.split(hidden @ w["hidden"].T, 3, axis=1)
        conv = np.zeros_like(f["conv"])
        rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        conv[rows, f["inside"].argmax(axis=1) + BEFORE - WIDTH // 2, filters] += top
        conv[:, BEFORE - WIDTH // 2 : BEFORE + PIECE - WIDTH // 2] += (mean / np.maximum(f["share"], 1))[:, None, :]
        conv[:, BEFORE - WIDTH // 2 : BEFORE + PIECE - WIDTH // 2] *= f["real"]
        conv[rows, f["before"].argmax(axis=1), filters] += before
        conv *= f["conv"] > 0
        flat = conv.reshape(-1, FILTERS)
        g["conv"], g["conv0"] = f["patches"].reshape(-1, WIDTH * VECTOR).T @ flat, flat.sum(axis=0)
        patches = (conv @ w["conv"].T).reshape(n, -1, WIDTH, VECTOR)
        g["vectors"] = np.zeros_like(w["vectors"])
        places = patches.shape[1]
        for k in range(WIDTH):
            np.add.at(g["vectors"], x[:, k : k + places], patches[:, :, k])
        g["vectors"][0] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, seed: int = 11) -> None:
        """Adam on the logistic loss."""
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                f = self._forward(x[part])
                slope = (1 / (1 + np.exp(-np.clip(f["score"], -30, 30))) - y[part]).astype(np.float32) / len(part)
                step += 1
                for k, g in self._backward(x[part], f, slope).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = 0.004 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.w[k] = (self.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    network: Network
    slope: float
    shift: float
    threshold: float  # of the calibrated probability
    recall: float  # and precision, on the findings set aside
    precision: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def calibrated(network: Network, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt's logistic curve, and the highest threshold up to one half that keeps RECALL of the secrets."""
    score = network.score(x).astype(float)
    slope, shift = logistic(score, y.astype(float))
    model = Model(network, slope, shift, 0.5, 0.0, 0.0)
    p = model.probability(score)
    secret = np.sort(p[y == 1])[::-1]
    threshold = min(0.5, float(secret[int(np.ceil(RECALL * len(secret))) - 1]))
    hit = p >= threshold
    return Model(network, slope, shift, threshold, float(hit[y == 1].mean()), float(y[hit].mean()))


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
LETTERS = LOWER + LOWER.upper()
# Beginnings and lengths of well-known kinds of credentials.
PREFIXES = (("ghp_", 36), ("gho_", 36), ("github_pat_", 40), ("glpat-", 20), ("xoxb-", 40), ("xoxp-", 44), ("AIza", 35),
            ("sk_live_", 24), ("rk_live_", 24), ("SG.", 60), ("hf_", 34), ("npm_", 36), ("ya29.", 60), ("eyJhbGciOiJIUzI1NiJ9.", 90))
# Words in front of credentials and of harmless strings.
BEFORE_SECRET = ("client_secret: ", "Authorization: Bearer ", "bearer ", "access_key=", "private key ", "credential: ",
                 "auth=", "pwd=", "passphrase: ", "export KEY=", "signing key: ", "")
BEFORE_OTHER = ("see ", "file ", "host ", "mail ", "call ", "order no. ", "at ", "version ", "image ", "doi:", "id ", "ref. ", "")
# Words in front of passwords that a person chose, and of other text behind the same marks.
BEFORE_PASSWORD = ("pwd=", "pwd: ", "pass: ", "pass=", "db_pass: ", "db_pwd=", "passphrase: ", "passphrase=", "Authorization: Bearer ", "Authorization: Basic ",
                   "bearer ", "auth=", "auth: ", "credential: ", "credentials=", "login key: ", "user_pass=", "my pwd is: ", "key: ", "key=")
BEFORE_TEXT = ("note: ", "name=", "title: ", "see: ", "http:", "https:", "date: ", "example: ", "author=", "subject: ", "city: ", "the following: ", "from: ",
               "id=", "page=", "lang: ", "re: ", "time: ", "color=", "style=", "class=", "ref=", "width: ", "e.g.: ", "as follows: ")


# Frequent syllables and letter groups of several languages.
SYLLABLES = ("the an in er on re he at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
             "au ber ble blea cion che con des die ein est eur gen haus ich ier ion ja keit kon la lich lo mai man mento mit nde nou ntth per pro que rro schen ser sie "
             "son sta ten tion tra tth tre tro un ung ver vie von wh win zu zo").split()


def generated(n: int, words: list[str], seed: int = 5) -> tuple[list[tuple[str, int, int]], list[int]]:
    """(text, start, end) of n credentials and n look-alikes among the given words, and their labels."""
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def drawn(alphabet, low, high=None):
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), low if high is None else int(rng.integers(low, high))))

    def word():
        # Half of the words are put together from syllables, so that no word is learned by heart.
        made = "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4)))) if rng.random() < 0.5 else pick(words)
        return re.sub(r"[^A-Za-z]", "", made).lower() or "word"

    def secret():
        prefix, length = pick(PREFIXES)
        return pick((
            lambda: prefix + drawn(LETTERS + DIGITS, length), lambda: drawn(LETTERS + DIGITS, 20, 64),
            lambda: drawn(LETTERS + DIGITS + "+/", 38, 86) + pick(("", "=", "==")), lambda: drawn("abcdef" + DIGITS, 18, 64),
            lambda: drawn(LOWER + DIGITS, 24, 48), lambda: drawn(LOWER.upper() + DIGITS, 18, 40),
            lambda: drawn(LETTERS + DIGITS + "_-", 22, 60), lambda: "AKIA" + drawn(LOWER.upper() + DIGITS, 16),
        ))()

    def other():
        number = drawn(DIGITS, 1, 6)
        return pick((
            lambda: f"{word()}{number}.example.{pick(('com', 'org', 'net'))}", lambda: f"www.{word()}{number}.{word()}.com/{word()}",
            lambda: f"/usr/lib/{word()}{number}/{word()}/{word()}", lambda: f"{word()}_{word()}_{word()}{number}",
            lambda: f"{word()}-{word()}-{number}.html", lambda: f"2024-0{pick('123456789')}-1{pick(DIGITS)}T1{pick(DIGITS)}.30.00Z",
            lambda: f"IMG_2023{drawn(DIGITS, 4)}_{drawn(DIGITS, 6)}.jpg", lambda: f"v{pick(DIGITS)}.{number}.{pick(DIGITS)}-{word()}.{pick(DIGITS)}",
            lambda: f"{word()}{word()}{word()}{word()}{pick(DIGITS)}", lambda: f"{word()}.{word()}.{number}.{word()}",
            lambda: f"{word().title()}{word().title()}{word().title()}{number}", lambda: f"+49-{drawn(DIGITS, 3)}-{drawn(DIGITS, 7)}-x{pick(DIGITS)}",
            lambda: f"10.{drawn(DIGITS, 4)}/{word()}.{drawn(DIGITS, 4)}.{drawn(DIGITS, 3)}", lambda: f"{word()}={word()}{pick(DIGITS)}={word()}",
        ))()

    def password():
        return pick((
            lambda: drawn(LETTERS + DIGITS, 8, 16), lambda: word() + drawn(DIGITS, 2, 6) + word(), lambda: word() + word() + word() + word(),
            lambda: drawn(LETTERS + DIGITS + "@!#$%&*?-_", 8, 20), lambda: word().title() + pick("@!#$%&*?") + word() + drawn(DIGITS, 1, 4),
            lambda: drawn(LOWER, 8, 24), lambda: drawn(DIGITS, 8, 20), lambda: word() + pick("-_.@") + word() + pick("!?#") + drawn(DIGITS, 2, 4),
        ))()

    def text():
        return pick((
            lambda: word() + word(), lambda: word().title() + word() + word(), lambda: f"//www.{word()}.com/{word()}", lambda: f"//{word()}.example.org/{drawn(DIGITS, 1, 5)}",
            lambda: f"2024-0{pick('123456789')}-1{pick(DIGITS)}", lambda: f"{drawn(DIGITS, 2)}:{drawn(DIGITS, 2)}:{drawn(DIGITS, 2)}", lambda: f"{word()}-{word()}-{word()}",
            lambda: f"{word()}@{word()}.com", lambda: f"{word()},{word()},{word()}", lambda: f"{word()}_{word()}", lambda: f"({word()}{word()})", lambda: drawn(DIGITS, 8, 12),
            lambda: f"{word()}/{word()}/{word()}",
        ))()

    rows, labels = [], []
    while len(labels) < 2 * n:
        label, chosen = len(labels) % 2, rng.random() < 0.5
        # Half of them are told by their context rather than by their look.
        string = (password() if label else text()) if chosen else (secret() if label else other())
        before = (BEFORE_PASSWORD if label else BEFORE_TEXT) if chosen else (BEFORE_SECRET if label else BEFORE_OTHER)
        front = f"{pick(words)} {pick(words)} {pick(before)}{pick(('', '', chr(34)))}"
        whole = f"{front}{string}{pick((' ', '. ', ', ', chr(34)))}{pick(words)}"
        for start, end in findings(whole)[1]:
            if start <= len(front) < end:
                rows.append((whole, start, end))
                labels.append(label)
                break
    return rows, labels


def labelled_findings(docs: DataFrame, training_docs: int, findings_kept: int) -> list[tuple[str, int, int, int]]:
    """(text around, start, end, label) of candidates in a sample of docs, labelled by the base rules."""

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                base, candidates = findings(text)
                for start, end in candidates:
                    label = any(a < end and start < b for _, a, b in base)
                    low = max(0, start - BEFORE)
                    rows.append((text[low : min(end, start + 4 * PIECE) + AFTER], start - low, min(end, start + 4 * PIECE) - low, int(label)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text", "start", "end", "label"])

    total = max(1, docs.count())
    share = min(1.0, training_docs / total)
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(share * 1_000_003))
    found = written(small_batches(texts).mapInArrow(scan, "text string, start int, end int, label int").distinct(), "findings")
    kept = [found.filter(F.col("label") == v).orderBy(F.xxhash64("text"), "text", "start").limit(findings_kept) for v in (0, 1)]
    return [tuple(r) for r in kept[0].unionByName(kept[1]).collect()]


# Plain words around generated findings.
FILLER = ("the", "of", "and", "is", "value", "for", "sind", "der", "wurde", "pour", "avec", "sur", "para", "donde", "esto",
          "server", "config", "please", "note", "then", "reading", "station", "thinking", "nothing", "other")


def train(docs: DataFrame, training_docs: int = TRAINING_DOCS, findings_kept: int = FINDINGS) -> Model:
    """The network of the docs' own findings and of the generated ones; four fifths train, the rest calibrates."""
    own = sorted(labelled_findings(docs, training_docs, findings_kept))
    made, labels = generated(GENERATED, list(FILLER))
    rows = [*own, *((*r, v) for r, v in zip(made, labels, strict=True))]
    x = np.stack([windows(t, a, min(b, a + PIECE))[0] for t, a, b, _ in rows])
    y = np.array([v for *_, v in rows], dtype=np.float32)
    order = np.random.default_rng(3).permutation(len(rows))
    x, y = x[order], y[order]
    cut = len(rows) // 5
    network = Network()
    network.train(x[cut:], y[cut:])
    return calibrated(network, x[:cut], y[:cut])


def scan_texts(texts: list[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: the base rules' and the network's beside them, by start and kind."""
    out, rows, owner, secret = [], [], [], set()

    def score():
        if rows:
            p = model.probability(model.network.score(np.stack(rows)))
            secret.update(owner[k] for k in np.flatnonzero(p >= model.threshold))
            rows.clear()
            owner.clear()

    for i, text in enumerate(texts):
        base, candidates = findings(text)
        out.append(base)
        for start, end in left_over(candidates, base):
            # A long candidate is cut in parts, so that few pieces are held at a time.
            for at in range(start, end, PIECE * SCORED_PIECES):
                pieces = windows(text, at, min(end, at + PIECE * SCORED_PIECES))
                rows += pieces
                owner += [(i, start, end)] * len(pieces)
                if len(rows) >= SCORED_PIECES:
                    score()
    score()
    for i, start, end in sorted(secret):
        out[i].append(("network", start, end))
    for spans in out:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def secret_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) for every row of docs.

    docs: doc_id, text; other columns are not read. A null text is empty and has no spans.
    Spans of different base kinds may overlap; the network adds none that overlaps them. Ties at
    a start are ordered as KINDS. Repeated rows give repeated rows, no rows none.
    """
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            found = scan_texts(batch.column(1).to_pylist(), sent.value)
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return small_batches(texts).mapInArrow(scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text."""

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:-1]], F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with MASK in place of each secret; the name in front of an assigned one stays."""
    parts, at = [], 0
    places = []
    for kind, start, end in spans:
        if kind == "assign":
            start = ASSIGN.match(text, start, end).start(2)
        places.append((start, end))
    for start, end in sorted(places):
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with secrets masked in text and n_chars (if there) counted anew in texts that changed."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = docs.columns
    at = place_of(docs, "text")

    def mask(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = scan_texts([t or "" for t in texts], sent.value)
            new = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                kept = batch.column(k).to_pylist()
                columns[k] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, kept, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(docs).mapInArrow(mask, docs.schema)
