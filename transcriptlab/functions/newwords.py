"""Column builders about what a later text says that a draft doesn't: new words, their support, and why a text must not replace a draft."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import texts as X
from .alignment import likeness
from .columns import let
from .roman import romanized
from ..sources.io import settled
from .rules import OPEN_ENDS

# Words that a later text may bring in, by why.
COMMON = tuple(
    """
    about after again also because before being could does done from have into like maybe need okay only right same should some that then
    there thing this through what when where which will with work would your
    """.split()
)
ROMAN = tuple(
    """
    aaj aajkal aap aapko aata aati aakar aaya abhi achcha achchha agar aisa aise alag alaava alawa aur baad baar baat baatein baaten bahan
    bangaal baithenge bata bhai bhi bol bola bolna bolte chaahie chahiye chal chala chale chalta chalti chhod de dekh den diya dikha dil din
    doosra dusra dusara eki factor ghi gaali godi haan hai hain har hamara hamaara hame hamen hi hoga hona hone hongi honge honi hoon hota
    hote hoti hua hui humein hamein isake ismein iske ismen ka kaam kaaphi kaise kar kara karake karen karega karke karna karne ki kuch kuchh
    kafi kabhi kaatna kaali kare karegi kisne kya karta karte karti khelna kyon laudi laga lagta likhane main matlab mein milega meri mere
    mujhe nahin nahi na naukri pae paega paengi paap paapi paayega paaye payega payengi pata pashchim par pichhali pichli raha rahe rahi roz
    sabka sab saara saare saari sare sari sakate sakta sakte samajh samajha samajhna samajho samksipta saath sankshipt taaki taki teesra tera
    tere teri tha thik theek tisra tisara to toone tu tum tune uttar uske usmen usmein vagairah vah vahi vaise vaisa vicara vichar vichaar
    vimarsa vimarsh vo woh ya yaar yah yaha jahaan jahan ye yeh uttara hawabaazi hawaabaazi havaavaaji
    """.split()
)
IDLE = tuple("aur bhai bhi de dekh haan hai hain hi matlab na par raha rahe rahi theek tha thik to vah vo woh ya yaar yah yaha ye".split())
STRICT = tuple(
    """
    and answer answered are api but can cannot do etc exactly for forth from have in into is it job like maybe mcp not okay of on one or
    question right same see so that tell thanks the then there this to what will with you
    """.split()
)
MEANING_STOP = (*COMMON, *IDLE, *"aap aapko agar aisa alag bhi hame hoga hona humein karna karne kuch kya nahi par raha rahe rahi saath sab uske vaisa vagairah".split())
WITNESS_STOP = (*COMMON, *STRICT, *"actually always anything basically best better cool going good great hard know look lower mother really searching something things whatever".split())
#: Reasons that name words which may be taken out of a text.
NEW = ("new-english-token:", "new-english-run:", "new-english-count:")
LIKE = 0.82


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(X.filled(text)), F.lit("[A-Za-z0-9]+"), F.lit(0))


def long_words(text: Column, least: int) -> Column:
    return F.filter(words_of(text), lambda w: F.length(w) >= least)


def plural_of(word: Column, known: Column) -> Column:
    """Whether known has the word with an s more or less."""
    return F.array_contains(known, F.concat(word, F.lit("s"))) | (word.endswith("s") & F.array_contains(known, F.regexp_replace(word, "s$", "")))


def unknown_words(draft: Column, final: Column, strict: bool = True, roman: bool = True, glossary: tuple[str, ...] = ()) -> Column:
    """Words of a final text with for each whether it is new: array of struct(word, new), words from 3 letters on if strict, else from 4.

    A word is known if the draft has it, its plural or its singular, or spells it across words that belong together (6 letters or more);
    if it is roman Hindi, of the glossary or, by ``strict``, one of few or of all common words.
    """
    least = 3 if strict else 4
    allowed = (*(ROMAN if roman else ()), *glossary, *(STRICT if strict else COMMON))
    sides = F.struct(long_words(draft, least).alias("d"), F.array_join(words_of(draft), "").alias("joined"), long_words(final, least).alias("f"))

    def judged(s: Column) -> Column:
        known = lambda w: w.isin(*allowed) | F.array_contains(s["d"], w) | ((F.length(w) >= 6) & F.contains(s["joined"], w)) | plural_of(w, s["d"])
        return F.transform(s["f"], lambda w: F.struct(w.alias("word"), (~known(w)).alias("new")))

    return let(sides, judged)


def new_english(draft: Column, final: Column, strict: bool = True, roman: bool = True, glossary: tuple[str, ...] = ()) -> Column:
    """Why a final text's new words are suspicious, with up to five of them, or null.

    If strict any new word is; else two next to each other are, with those up to there, or two different ones.
    """

    def reason(s: Column) -> Column:
        new = lambda upto: F.transform(F.filter(F.slice(s, F.lit(1), upto), lambda x: x["new"]), lambda x: x["word"])
        named = lambda label, w: F.concat(F.lit(label), F.array_join(F.slice(w, 1, 5), ","))
        if strict:
            return let(new(F.size(s)), lambda w: F.when(F.size(w) > 0, named(NEW[0], w)))
        run = F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2))), lambda i: F.coalesce(F.try_element_at(s, i)["new"], F.lit(False)) & F.element_at(s, i - 1)["new"]))
        some = let(new(F.size(s)), lambda w: F.when(F.size(F.array_distinct(w)) >= 2, named(NEW[2], w)))
        return F.when(F.size(s) == 0, None).otherwise(let(run, lambda r: F.when(r.isNotNull(), let(new(r), lambda w: named(NEW[1], w))).otherwise(some)))

    return let(unknown_words(draft, final, strict, roman, glossary), reason)


def reject_reasons(draft: Column, final: Column, tail_seconds: Column, most_seconds: float, strict: bool = True, roman: bool = True, glossary: tuple[str, ...] = ()) -> Column:
    """Why a late text must not replace a draft, its new words too; empty if it may."""
    return F.array_compact(F.concat(X.update_reasons(draft, final, tail_seconds, most_seconds), F.array(new_english(draft, final, strict, roman, glossary))))


def new_roman(draft: Column, final: Column) -> Column:
    """New roman Hindi words of a final text that carry something, sorted; its Devanagari counts in Latin letters."""
    said = tuple(w for w in ROMAN if w not in IDLE)
    has = lambda t: F.filter(words_of(t), lambda w: w.isin(*said))
    return F.array_sort(F.array_except(F.array_union(has(final), has(romanized(final))), has(draft)))


def meaning_kept(draft: Column, final: Column) -> Column:
    """Why a final text doesn't improve the meaning of a draft: an array of one reason, or none if either has under 4 words of content."""
    content = lambda t: F.filter(words_of(romanized(t)), lambda w: (F.length(w) >= 4) & ~w.isin(*MEANING_STOP))
    last = F.element_at(F.concat(F.array(F.lit("")), words_of(romanized(final))), -1)
    facts = F.struct(content(draft).alias("d"), content(final).alias("f"), F.size(new_roman(draft, final)).alias("value"), last.alias("last"))

    def reasons(x: Column) -> Column:
        d, f = F.array_distinct(x["d"]), F.array_distinct(x["f"])
        kept, new, gone = F.size(F.array_intersect(d, f)) / F.greatest(F.lit(1), F.size(d)), F.size(F.array_except(f, d)), F.size(F.array_except(d, f))
        share = F.format_string("%.2f", kept)
        one = (
            F.when((F.size(x["d"]) < 4) | (F.size(x["f"]) < 4), None)
            .when(x["last"].isin(*OPEN_ENDS), "incomplete-tail")
            .when((x["value"] >= 5) & ((F.size(x["f"]) >= 5) | (kept >= 0.65)), None)
            .when((kept < 0.78) & (new < 6), F.concat(F.lit("default-meaning-drop:"), share))
            .when(new < 3, "no-default-meaning-gain")
            .when((kept < 0.85) & (gone >= 2), F.concat(F.lit("default-meaning-tradeoff:"), share))
        )
        return F.array_compact(F.array(one))

    return let(facts, reasons)


def named_words(reasons: Column) -> Column:
    """Words that reasons name as new, each once."""
    of = F.filter(reasons, lambda r: r.rlike("^(" + "|".join(NEW) + ")"))
    words = F.flatten(F.transform(of, lambda r: F.split(F.regexp_replace(r, "^[^:]*:", ""), ",")))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: w != ""))


def backed(word: Column, witness: Column) -> Column:
    """Whether a witness's words have a word, its plural or singular, or, from 5 letters on, one that holds it or that it holds."""
    within = F.exists(witness, lambda v: (F.length(v) >= 5) & (F.contains(v, word) | F.contains(word, v)))
    return F.array_contains(witness, word) | plural_of(word, witness) | ((F.length(word) >= 5) & within)


def witness_support(draft: Column, candidate: Column, witness: Column) -> Column:
    """struct(supported, unsupported): a candidate's new words of content, and whether a third text has them too."""
    sides = F.struct(long_words(draft, 3).alias("d"), long_words(witness, 3).alias("w"), F.array_distinct(long_words(candidate, 4)).alias("c"))

    def split(s: Column) -> Column:
        new = F.filter(s["c"], lambda w: ~F.array_contains(s["d"], w) & ~plural_of(w, s["d"]) & ~w.isin(*WITNESS_STOP) & ~w.isin(*ROMAN))
        return let(new, lambda n: F.struct(F.filter(n, lambda w: backed(w, s["w"])).alias("supported"), F.filter(n, lambda w: ~backed(w, s["w"])).alias("unsupported")))

    return let(sides, split)


def witness_verdict(rows, draft: str = "draft", candidate: str = "candidate", witness: str = "witness", reasons: str = "reasons", key: str = "id"):
    """rows with ``verdict``: whether a third text lets in a candidate that was rejected for its new words.

    accepted if there are reasons, none but new words and lacking Hindi, some new word is supported, each word that a reason names is
    too, or is half of a compound with its neighbour that the witness has or nearly has (likeness LIKE), and at most three times
    as many new words are unsupported, or four.  Nearly equal compounds are found by a join of those of like lengths.
    """
    d, c, w, why = F.col(draft), F.col(candidate), F.col(witness), F.col(reasons)
    held = rows.withColumn("_s", witness_support(d, c, w)).withColumn("_w", F.array_distinct(long_words(w, 3))).withColumn("_n", named_words(why))
    blocking = F.filter(why, lambda r: ~r.rlike("^(new-english-|no-hindi-value)"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_n") - 1, F.lit(1))), lambda i: F.concat(F.try_element_at(F.col("_n"), i), F.try_element_at(F.col("_n"), i + 1)))
    held = settled(held).withColumn("_compounds", F.filter(pairs, lambda x: x.isNotNull() & (F.length(x) >= 8))).withColumn("_blocking", blocking)
    # 2m / (a + b) can't reach LIKE where the shorter has under LIKE / (2 - LIKE) of the longer's letters
    left = held.select(key, F.explode("_compounds").alias("compound"), F.col("_w").alias("_words"))
    near = left.select(key, "compound", F.explode(F.filter("_words", lambda v: F.length(v) >= 8)).alias("word"))
    a, b = F.length("compound"), F.length("word")
    fits = near.filter(F.least(a, b) + 1e-9 >= LIKE / (2 - LIKE) * F.greatest(a, b)).withColumn("like", likeness(F.col("compound"), F.col("word")))
    found = fits.filter(F.col("like") >= LIKE).groupBy(key).agg(F.collect_set("compound").alias("_near"))
    none = F.array().cast("array<string>")
    held = held.join(found, key, "left").withColumn("_near", F.coalesce("_near", none))
    whole = lambda x: F.coalesce((F.length(x) >= 8) & (backed(x, F.col("_w")) | F.array_contains("_near", x)), F.lit(False))
    beside = lambda i: whole(F.concat(F.try_element_at(F.col("_n"), F.when(i > 1, i - 1)), F.element_at("_n", i))) | whole(F.concat(F.element_at("_n", i), F.try_element_at(F.col("_n"), i + 1)))
    places = F.when(F.size("_n") > 0, F.sequence(F.lit(1), F.size("_n"))).otherwise(F.array().cast("array<int>"))
    alone = F.filter(places, lambda i: ~F.array_contains("_s.supported", F.element_at("_n", i)) & ~backed(F.element_at("_n", i), F.col("_w")) & ~beside(i))
    alone = F.transform(alone, lambda i: F.element_at("_n", i))
    most = F.greatest(F.lit(4), 3 * F.size("_s.supported"))
    held = held.withColumn("_alone", alone)
    accepted = (F.size(why) > 0) & (F.size("_blocking") == 0) & (F.size("_s.supported") > 0) & (F.size("_alone") == 0) & (F.size("_s.unsupported") <= most)
    verdict = F.struct(accepted.alias("accepted"), F.col("_s.supported").alias("supported"), F.col("_s.unsupported").alias("unsupported"), F.col("_n").alias("named"), F.col("_alone").alias("unsupported_named"), F.col("_blocking").alias("blocking"), most.alias("most"))
    return held.withColumn("verdict", verdict).drop("_s", "_w", "_n", "_compounds", "_blocking", "_near", "_alone")
