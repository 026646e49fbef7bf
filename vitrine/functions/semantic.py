"""Semantic query cleanup: tokens that keep inner apostrophes, a stop list, kept negation, n-grams of what is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_ngrams, normalize_text

#: Words that carry no product meaning in a query.
STOPWORDS = tuple("""
i i'd i'm i've i'll me my mine myself we we're we'd we'll we've our ours ourselves you you're you'd you'll you've your yours
yourself yourselves he he's him his himself she she's her hers herself they they're they'd they'll they've them their
themselves it it's that's a an the this that these those what which who whom some something anything please want wants wanted
need needs needed like likes liked prefer prefers preferred looking look looks find finds found show shows give gives given
make makes made making use uses used using mainly primarily mostly would could should can will may might must shall ought am
is are was were be been being have has had having do does did doing for from of to with by at as and or but actually rather
under below less than more over between around about within let's who's what's here's there's when's where's why's how's if
because until while against into through during before after again further then once here there when where why how all any
both each few most other such so too very ever also just whether however
""".split())
#: Contractions that mean "not".
NEGATIONS = tuple("""
don't doesn't didn't can't won't isn't aren't wasn't weren't haven't hasn't hadn't wouldn't couldn't shouldn't cannot shan't
mustn't daren't needn't oughtn't mightn't
""".split())
#: The same in DuckDB's SQL, for the queries' checks.
SQL_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"
SQL_NOT = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in NEGATIONS) + "]"


def tokens(value: Column) -> Column:
    """Words in lower case; an apostrophe of any kind inside a word stays, as '."""
    x = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[’ʼ＇]", "'")
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+(?:'+[\p{L}\p{N}]+)*"), F.lit(0))


def query_tokens(value: Column, more: tuple[str, ...] = ()) -> Column:
    """Tokens without stop words; a negative contraction is "not"; other apostrophes go as in surface normalisation."""
    stop = STOPWORDS + more
    kept = F.filter(tokens(value), lambda t: t.isin(*NEGATIONS) | ~t.isin(*stop))
    plain = F.transform(kept, lambda t: F.when(t.isin(*NEGATIONS), F.lit("not")).otherwise(normalize_text(t)))
    return F.filter(plain, lambda t: (t == "not") | ((t != "") & ~t.isin(*stop)))


def query_ngrams(value: Column, most: int = 3) -> Column:
    """Distinct contiguous n-grams of the cleaned tokens, shortest first."""
    return all_ngrams(query_tokens(value), most)
