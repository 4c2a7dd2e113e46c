"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens fetch the few rules whose rarest token it holds, and only those run their regular expressions. Rarity is
the number of URLs that hold the token, counted over the whole table; rules without a literal token, if any, are tried on
every URL. Site rules (host/path) go first; where none fits, rules in the common filter syntax decide (`filter_rule`).
A null URL or one without :// has an empty host and path, no token and no rule, and is allowed; ties between rules of one
length go to the rule that sorts first. Bytes that are no UTF-8 count as U+FFFD. A very long URL costs its tokens and the
rules that they fetch; repeated URLs get the same verdict each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decoded, map_texts, slices, text_column, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[0-9a-z]+")


@dataclass(frozen=True)
class Rule:
    """A rule's name, its verdict, the regular expression for host + path, and literal tokens that any match holds whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def site_rule(name: str, verdict: str) -> Rule:
    """host/path: fits the host and its subdomains where the path starts with the rule's."""
    host, slash, path = name.partition("/")
    prefix = (slash + path).translate(LOWER)
    whole = TOKEN.findall(host.translate(LOWER)) + [m[0] for m in TOKEN.finditer(prefix) if m.end() < len(prefix)]
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(whole))


def filter_rule(name: str) -> Rule:
    """A rule in the common filter syntax, for host + path with A-Z in lower case.

    `||` at the start: where the host or one of its labels starts; else the rule may fit anywhere. `*`: any signs.
    `^`: a separator (none of 0-9 a-z _ - . %) or the end. `@@` before it all: an exception, which allows.
    """
    body = name.removeprefix("@@")
    labelled = body.startswith("||")
    body = body.removeprefix("||")
    parts = {"*": ".*", "^": r"(?:[^0-9a-z_.%-]|\Z)"}
    pattern = (r"(?:[^/]*\.)?" if labelled else ".*?") + "".join(parts.get(c) or re.escape(c) for c in body)
    whole = [m[0] for m in TOKEN.finditer(body) if (body[m.start() - 1] != "*" if m.start() else labelled) and m.end() < len(body) and body[m.end()] != "*"]
    return Rule(name, "allow" if name.startswith("@@") else "block", pattern, tuple(whole))


#: Rules whose names are reported; the longest that fits wins.
SITE_RULES = (site_rule("org/", "allow"), site_rule("example.org/es/", "block"), site_rule("example.org/en/1", "block"), site_rule("com/fr/", "allow"), site_rule("com/de/", "block"))
#: What the method's own rules are made of: unwanted topics and what their sites add, advertising and where it is served from, sign-in and shop pages.
TOPICS = ("adult", "casino", "cam", "escort", "keygen", "lottery", "pills", "poker", "porn", "replica", "roulette", "sex", "slots", "spam", "warez", "xxx")
TAILS = ("bonus", "club", "farm", "free", "hub", "live", "mart", "online", "shop", "tube", "vip", "win", "x")
ADS = ("ad", "ads", "adserver", "advert", "affiliate", "banner", "banners", "beacon", "pixel", "popup", "promo", "sponsor", "track", "tracker", "tracking")
PLACES = ("click", "collect", "img", "js", "log", "redirect", "serve", "view")
SERVERS = ("cdn", "net", "server", "track")
PAGES = ("login", "signin", "cart", "checkout")
#: The method's own rules, which decide where no site rule fits; exceptions go before all others.
PATTERN_RULES = tuple(
    map(
        filter_rule,
        [f"||{t}-{x}." for t in TOPICS for x in TAILS]
        + [f"||{t}." for t in (*TOPICS, *ADS)]
        + [f"||{a}-{x}." for a in ADS for x in SERVERS]
        + [f"||{a}-*/{p}/" for a in ADS for p in PLACES]
        + [f"/{a}/{p}/" for a in ADS for p in PLACES]
        + [f"/{p}^" for p in PAGES]
        + [f"@@||{t}-help." for t in TOPICS]
        + [f"@@||{t}.*/help/" for t in TOPICS],
    )
)


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z in lower case) and path."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = next((m.start() for m in re.finditer(r"[/?#]", rest)), len(rest))
    cut = next((m.start() for m in re.finditer(r"[?#]", rest[end:])), len(rest) - end)
    return rest[:end].translate(LOWER), rest[end : end + cut]


def url_tokens(host: str, path: str) -> set[str]:
    return set(TOKEN.findall((host + path).translate(LOWER)))


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules, frequency: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for r in rules:
            rarest = min(r.tokens, key=lambda t: (frequency.get(t, 0), t), default=None)
            (self.always if rarest is None else self.by_token.setdefault(rarest, [])).append((r, re.compile(r.pattern, re.DOTALL)))

    def candidates(self, tokens: set[str]) -> list:
        """Rules, with their regular expressions, that the tokens fetch."""
        return self.always + [x for t in self.by_token.keys() & tokens for x in self.by_token[t]]

    def best(self, url: str, tokens: set[str], exceptions: bool = False) -> Rule | None:
        """Of the rules that fit the longest; exceptions (allowing rules) first, if they are such."""
        found = [r for r, p in self.candidates(tokens) if p.match(url)]
        return min(found, key=lambda r: (exceptions and r.verdict != "allow", -len(r.name), r.name), default=None)


def token_frequency(df: DataFrame, rules, url_col: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs; at most one row for each such token reaches the driver."""
    wanted = {t for r in rules for t in r.tokens}

    def run(batches):
        seen = Counter()
        for part in slices(batches):
            for url in text_column(part):
                seen.update(url_tokens(*split_url(decoded(url))) & wanted)
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return {r["token"]: r["n"] for r in texts(df, url_col).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


def judge(df: DataFrame, url_col: str = "url", keep: list[str] | None = None, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict and pattern (the method's rule, if that decided) to the kept columns."""
    keep = list(df.columns) if keep is None else keep
    frequency = token_frequency(df, [*site_rules, *pattern_rules], url_col)

    index = []

    def each(found, _):
        if not index:
            index.extend((RuleIndex(site_rules, frequency), RuleIndex(pattern_rules, frequency)))
        rows = []
        for t in found:
            host, path = split_url(decoded(t))
            tokens = url_tokens(host, path)
            site = index[0].best(host + path, tokens)
            own = None if site else index[1].best((host + path).translate(LOWER), tokens, exceptions=True)
            rows.append((host, path, site and site.name, (site or own).verdict if site or own else default, own and own.name))
        return rows

    return map_texts(df, url_col, keep, "host string, path string, rule string, verdict string, pattern string", each)
