"""All of a pack's words and patterns in one pass over a text.

The lists of a rule pack become the bits of a number: bit k tells that the text has a pattern of list k. Words and phrases
are found by one Aho-Corasick automaton, whose work doesn't grow with their number. A pattern that is no plain phrase is tried
only where the text has one of the phrases without which it can't match, which the automaton finds as well. Every rule then
reads bits, so that a text is scanned once, whatever is asked about it. The answers are those of the patterns in `rules`.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from brevier.functions.text import column, keyword_pattern, matches_source
from brevier.operators import rules as R

#: Letters beyond A to Z that match them whatever the case.
FOLDED = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})
WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]")
#: Bits of a number that Spark keeps without its sign.
MOST_LISTS = 62


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(FOLDED).lower()


def phrase(pattern: str) -> tuple[str, bool, bool] | None:
    """(text, at a word's start, at a word's end) of a pattern that is a plain phrase, else None."""
    left, right = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    parsed = [*re._parser.parse(pattern[2 * left : len(pattern) - 2 * right], re.I)]
    if parsed and all(op is re._constants.LITERAL for op, _ in parsed):
        return "".join(chr(c) for _, c in parsed), left, right
    return None


def needed(parsed) -> list[str] | None:
    """Phrases of which a text must have one for the pattern to match; None if there are none such."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is re._constants.LITERAL:
            run += chr(value)
            continue
        found += [[run]] * bool(run)
        run = ""
        if op is re._constants.SUBPATTERN:
            found.append(needed(value[-1]))
        elif op is re._constants.BRANCH:
            each = [needed(branch) for branch in value[1]]
            found.append(sum(each, []) if all(each) else None)
        elif op is re._constants.MAX_REPEAT and value[0] >= 1:
            found.append(needed(value[2]))
    return max(filter(None, found), key=lambda xs: min(map(len, xs)), default=None)


class Scanner:
    """The automaton of named lists of patterns; built where it is used, so that it travels as its lists."""

    def __init__(self, lists: dict[str, list[str]]):
        if len(lists) > MOST_LISTS:
            raise ValueError(f"over {MOST_LISTS} lists")
        self.lists, self.automaton = lists, None

    def __getstate__(self):
        return {"lists": self.lists, "automaton": None}

    def build(self) -> None:
        words, self.patterns, self.always = {}, [], []
        for k, patterns in enumerate(self.lists.values()):
            for pattern in patterns:
                plain = phrase(pattern)
                if plain:
                    words.setdefault(fold(plain[0]), []).append((1 << k, *plain[1:], None))
                    continue
                self.patterns.append((1 << k, regex.compile(pattern, regex.I)))
                wanted = needed(re._parser.parse(pattern, re.I))
                if not wanted:
                    self.always.append(len(self.patterns) - 1)
                for text in wanted or []:
                    words.setdefault(fold(text), []).append((0, False, False, len(self.patterns) - 1))
        self.automaton = ahocorasick.Automaton()
        for text, uses in words.items():
            self.automaton.add_word(text, (len(text), reduce(int.__or__, (u[0] for u in uses)), uses))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> int:
        """The bits of the lists that the text has a pattern of."""
        if self.automaton is None:
            self.build()
        text, bits = text or "", 0
        folded, tried = fold(text), {*self.always}
        for end, (length, all_bits, uses) in self.automaton.iter(folded) if len(self.automaton) else ():
            if all_bits and bits & all_bits == all_bits and len(uses) == all_bits.bit_count():
                continue
            start = end + 1 - length
            for bit, left, right, at in uses:
                if at is not None:
                    tried.add(at)
                elif not bits & bit and (not left or self.edge(folded, start)) and (not right or self.edge(folded, end + 1)):
                    bits |= bit
        for at in tried:
            bit, pattern = self.patterns[at]
            if not bits & bit and pattern.search(text):
                bits |= bit
        return bits

    @staticmethod
    def edge(text: str, at: int) -> bool:
        """Whether a word starts or ends here."""
        before = at > 0 and WORD.match(text[at - 1]) is not None
        after = at < len(text) and WORD.match(text[at]) is not None
        return before != after


def lists_of(pack: R.RulePack) -> dict[str, list[str]]:
    """The pack's lists by the name that a rule asks for them by."""
    named = {f"brand {name}": patterns for name, patterns in pack.brands}
    named |= {f"product {name}": R.words(keywords) for name, keywords in pack.products}
    named |= {f"context {name}": [context] for name, context in pack.brand_context.items()}
    return named | {
        "finance": R.words(pack.finance),
        "tech": [re.escape(k) for k in pack.tech],
        "relevant": R.words(pack.relevant),
        "off topic": R.words(pack.off_topic),
        "noise": pack.noise,
        "apparel": pack.apparel,
        "exempt": [keyword_pattern(k) for k in pack.exempt],
        "spam": pack.spam,
        "celebrity": [re.escape(k) for k in pack.celebrity],
        "product off topic": [pack.product_off_topic],
        "product strong": [pack.product_strong],
    }


class Rules:
    """A pack's rules over texts that were scanned once: `hits` makes the column that all others read."""

    def __init__(self, pack: R.RulePack):
        self.pack, self.lists = pack, lists_of(pack)
        self.bit = {name: 1 << k for k, name in enumerate(self.lists)}

    def hits(self, title: Column | str, summary: Column | str) -> Column:
        """The bits of title and summary. A plan makes them once: filters on what follows from them stay above."""
        scanner = Scanner(self.lists)

        @F.arrow_udf("bigint")
        def scan(texts: pa.Array) -> pa.Array:
            return pa.array((scanner.scan(t.as_py()) for t in texts), pa.int64())  # one text at a time leaves Arrow

        return scan.asNondeterministic()(R.body(title, summary))

    def has(self, hits: Column | str, name: str) -> Column:
        return column(hits).bitwiseAND(F.lit(self.bit[name])) != 0

    def first(self, hits: Column | str, kind: str, names: list[str]) -> Column:
        chain = F
        for name in names:
            chain = chain.when(self.has(hits, f"{kind} {name}"), name)
        return chain if names else F.lit(None).cast("string")

    def brand(self, hits: Column | str) -> Column:
        return self.first(hits, "brand", [name for name, _ in self.pack.brands])

    def product(self, hits: Column | str) -> Column:
        return F.coalesce(self.first(hits, "product", [name for name, _ in self.pack.products]), F.lit("other"))

    def category(self, hits: Column | str, brand: Column | str) -> Column:
        known, brand = R.has_brand(column(brand)), column(brand)
        return (
            F.when(self.has(hits, "finance"), "finance")
            .when(known & brand.isin(self.pack.own_brands), "brand")
            .when(known, "competitor")
            .when(self.has(hits, "tech"), "tech")
            .otherwise("market")
        )

    def ambiguity(self, hits: Column | str, brand: Column | str) -> Column:
        brand = column(brand)
        chain = F.when(brand.isin(list(self.pack.brand_context)) & self.has(hits, "celebrity"), "celebrity_noise")
        for name in self.pack.brand_context:
            chain = chain.when((brand == name) & ~self.has(hits, f"context {name}"), "brand_ambiguous_no_context")
        return chain

    def exclusion_reason(self, hits: Column | str, brand: Column | str, source: Column | str, relax: Column | bool = False) -> Column:
        known, unclear = R.has_brand(column(brand)), self.ambiguity(hits, brand)
        relaxed = F.lit(relax) if isinstance(relax, bool) else relax
        return (
            F.when(matches_source(source, self.pack.spam_sources), "marketplace_spam")
            .when(self.has(hits, "spam"), "marketplace_spam")
            .when(unclear.isNotNull(), unclear)
            .when(self.has(hits, "noise"), "cross_industry_noise")
            .when(self.has(hits, "apparel") & ~self.has(hits, "exempt"), "apparel_noise")
            .when(~known & self.has(hits, "off topic"), "off_topic")
            .when(~relaxed & ~known & ~self.has(hits, "relevant"), "no_relevance")
        )

    def is_off_topic_product(self, hits: Column | str, brand: Column | str) -> Column:
        return ~R.has_brand(column(brand)) & self.has(hits, "product off topic") & ~self.has(hits, "product strong")
