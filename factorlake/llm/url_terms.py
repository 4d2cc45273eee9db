"""URL verdicts from host rules and a weighted vocabulary counted with Aho-Corasick."""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)

STRICT_TERMS = ("porn", "xxx", "sexcam", "hentai", "escort", "warez", "phishing", "malware", "keygen", "viagra")
SOFT_TERMS = ("ads", "track", "tracker", "banner", "click", "casino", "poker", "bet", "loan", "dating", "coupon", "torrent", "crack", "free", "pills", "adult", "nude", "sex")
CONTRACT_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@dataclass(frozen=True)
class Vocabulary:
    """Terms count only where neither neighbour is an ASCII letter or digit. One strict term, or ``soft_hits``
    different soft terms, block a URL."""
    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_hits: int = 2
    rules: tuple[tuple[str, str, str], ...] = field(default=CONTRACT_RULES)


def _split(url: str | None) -> tuple[str, str]:
    """Lower-case host and path; both empty without a scheme separator."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    return rest[:at].translate(TO_LOWER), rest[at:].split("?", 1)[0].split("#", 1)[0]


class _Judge:
    def __init__(self, words: Vocabulary):
        self.words, self.by_host = words, {}
        for host, path, verdict in words.rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))
        for paths in self.by_host.values():
            paths.sort(key=lambda r: -len(r[0]))
        self.machine = ahocorasick.Automaton()
        for term in (*words.strict, *words.soft):
            self.machine.add_word(term, term)
        self.machine.make_automaton()
        self.strict = frozenset(words.strict)

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits: rules of the host and of every domain above it."""
        best, at = None, 0
        while host and at >= 0:
            for start, text, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(text) > len(best[0])):
                    best = text, verdict
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best

    def terms(self, url: str) -> tuple[int, int]:
        """Occurrences of strict terms and the number of different soft terms, with boundary checks."""
        text, strict, soft = url.translate(TO_LOWER), 0, set()
        for end, term in self.machine.iter(text):
            start = end - len(term)
            before, after = text[start:start + 1] if start >= 0 else "", text[end + 1:end + 2]
            if (before.isascii() and before.isalnum()) or (after.isascii() and after.isalnum()):
                continue
            if term in self.strict:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)

    def __call__(self, url: str | None) -> tuple:
        host, path = _split(url)
        strict, soft = self.terms(url or "") if len(self.machine) else (0, 0)
        found = self.rule(host, path)
        verdict = found[1] if found else "block" if strict or soft >= self.words.soft_hits else "allow"
        return host, path, found[0] if found else None, verdict, strict, soft


SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()),
                       T.StructField("strict_hits", T.LongType()), T.StructField("soft_hits", T.LongType())])


def judge(pages: DataFrame, words: Vocabulary = Vocabulary(), url: str = "url") -> DataFrame:
    """Adds the struct ``judged`` (host, path, rule, verdict, strict_hits, soft_hits) to every row.

    One pass without any shuffle. A null or empty URL has empty host and path, no rule and no terms and
    is allowed. A rule fits its host and all subdomains when the URL's path starts with the rule's; the
    longest host and path together wins. Repeated rows are judged alike; other columns stay as they are.
    """
    @F.pandas_udf(SCHEMA)
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        one = _Judge(words)
        return pd.DataFrame([one(u) for u in urls], columns=SCHEMA.names)

    return pages.withColumn("judged", verdicts(F.col(url)))
