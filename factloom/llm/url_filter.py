"""URL filter: glob rules packed into multiword Shift-And masks, all simulated at once over each URL.

Symbols are the 256 bytes, one that ends the host and one that ends the URL. Bit s of the state is set
while the first s + 1 symbols of some rule have been read. Per symbol c the state becomes
((state << 1 | first) & reads[c]) | (state & loops): `reads` has the rule symbols that c matches,
`loops` the places before a `*`, where any symbol may pass. A batch of URLs is advanced one symbol at a
time, one row of 64-bit words for each URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

HOST_END, URL_END, ALPHABET = 256, 257, 258

#: Fixed values of the contract: host suffix, path prefix, verdict; the longest rule that fits decides.
SITE_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Globs over `host` + `path` for URLs that no site rule fits: `*` is any run of symbols.
BLOCK_GLOBS = [
    "*spam*", "*cheap-*", "*-pills.*", "*casino*", "*gambl*", "*porn*", "*xxx*", "*adult*", "*escort*", "*viagra*",
    "*phish*", "*malware*", "*warez*", "*torrent*", "*crack-*", "*keygen*", "*free-money*", "*get-rich*", "*payday-loan*",
    "*link-farm*", "*linkfarm*", "*click-bait*", "*clickbait*", "*doorway*", "ads.*", "*.ads.*", "adserver.*",
    "*.adserver.*", "tracker.*", "*.tracker.*", "*/wp-login.php", "*/cgi-bin/*", "*/login", "*/login/", "*/signup", "*/cart",
    "*/cart/", "*/checkout/*", "*.jpg", "*.jpeg", "*.png", "*.gif", "*.zip", "*.exe", "*.mp3", "*.mp4",
]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host up to / ? # after the first ://, A-Z lower-cased; path up to ? or #."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


class GlobSet:
    """Rules given as lists of symbols; a None is `*`."""

    def __init__(self, rules: list[list[int | None]]) -> None:
        size = sum(sum(s is not None for s in r) + 1 for r in rules)
        self.words = size // 64 + 1
        self.reads = np.zeros((ALPHABET, self.words), np.uint64)
        self.first, self.loops = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.ends: list[int] = []
        at = 0
        for rule in rules:  # bit `at` stands for the place before the rule's first symbol
            self._set(self.first, at)
            for symbol in rule:
                if symbol is None:
                    self._set(self.loops, at)
                else:
                    at += 1
                    self._set(self.reads[symbol], at)
            self.ends.append(at)
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def matches(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row for each text and a column for each rule: whether the rule matches the whole text.

        Texts stand one after the other in one array, so a long one takes no room beside the short ones.
        """
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([np.zeros(0, np.int16), *texts])
        starts, alive = (np.cumsum(lengths) - lengths)[order], lengths[order]
        state = np.tile(self.first, (n, 1))
        for column in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-alive, -column, side="left"))  # texts longer than `column` come first
            now = state[:m]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.reads[flat[starts[:m] + column]]) | (now & self.loops)
        out = np.zeros((n, len(self.ends)), bool)
        for rule, bit in enumerate(self.ends):
            out[order, rule] = (state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)
        return out


def _symbols(host: str, path: str) -> np.ndarray:
    """A dot before the host lets `.org` fit the host and all its subdomains."""
    bytes_of = lambda s: np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
    ends = lambda x: np.array([x], np.int16)
    return np.concatenate([ends(ord(".")), bytes_of(host), ends(HOST_END), bytes_of(path), ends(URL_END)])


def site_glob(host: str, path: str) -> list[int | None]:
    return [None, *_symbols(host, path)[:-1].tolist(), None, URL_END]


def free_globs(glob: str) -> list[list[int | None]]:
    """A glob over host + path: the end of the host may stand at any place of it, or inside a `*`."""
    symbols = [None if c == "*" else ord(c) for c in glob]
    return [
        [ord("."), *symbols[:at], HOST_END, *symbols[at:], URL_END] for at in range(len(symbols) + 1)
    ] + [
        [ord("."), *symbols[:at], None, HOST_END, None, *symbols[at + 1 :], URL_END]
        for at, s in enumerate(symbols)
        if s is None
    ]


class UrlRules:
    """Site rules and block globs in one automaton."""

    def __init__(self, site_rules: list[tuple[str, str, str]], block_globs: list[str]) -> None:
        self.sites = site_rules
        globs = [site_glob(h, p) for h, p, _ in site_rules]
        self.blocks = {tuple(g) for b in block_globs for g in free_globs(b)}
        self.automaton = GlobSet(globs + [list(g) for g in sorted(self.blocks, key=str)])

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) for each URL."""
        parts = [split_url(u) for u in urls]
        distinct = list(dict.fromkeys(parts))
        hit = self.automaton.matches([_symbols(*p) for p in distinct])
        n = len(self.sites)
        longest = sorted(range(n), key=lambda r: -len(self.sites[r][0] + self.sites[r][1]))
        verdicts = {}
        for part, row in zip(distinct, hit, strict=True):
            rule = next((r for r in longest if row[r]), None)
            if rule is not None:
                host, path, verdict = self.sites[rule]
                verdicts[part] = (*part, host + path, verdict)
            else:
                verdicts[part] = (*part, None, "block" if row[n:].any() else "allow")
        return [verdicts[p] for p in parts]


JUDGED = StructType(
    [
        StructField("page_id", LongType()),
        StructField("host", StringType()),
        StructField("path", StringType()),
        StructField("rule", StringType()),
        StructField("verdict", StringType()),
    ]
)


def judge_urls(
    pages: DataFrame, site_rules: list[tuple[str, str, str]] = SITE_RULES, block_globs: list[str] = BLOCK_GLOBS
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    A null URL or one without `://` has an empty host and path, which no site rule fits; without a rule
    the globs decide: block if any matches, else allow. URLs may be of any length. Rows may repeat. An empty table gives an empty
    one. Other columns are not read.
    """
    arrow = to_arrow_schema(JUDGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = UrlRules(site_rules, block_globs)
        for batch in batches:
            made = list(zip(*rules.judge(batch.column(1).to_pylist()), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in made)], schema=arrow)

    return pages.select("page_id", "url").mapInArrow(run, JUDGED)
