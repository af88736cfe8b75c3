"""De-inflection by a table of suffix rules, and what follows from it: candidates, matches, the part-of-speech filter, the dictionary hop.

A rule turns suffix_in into suffix_out. It may be the first step of a chain; after another step it may follow only if what that
step left (conditions) shares a bit with its cond_in. It leaves cond_out. Chains have any length: `check_rules` proves of a table that they end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Bits of the kinds of words, and those by rule name, as terms carry them in `rules`. The kinds from TE on are no words of a lexicon.
N, V, ADJ, V1, V5, ADJ_I, VS, VK, VZ, V_AR, V_ER, V_IR, ADV = (1 << i for i in range(13))
TE, POLITE, REFLEXIVE = (1 << i for i in range(20, 23))
CONDITIONS = {"n": N, "ns": N, "v": V, "adj": ADJ, "v1": V1, "v5": V5, "v5k": V5, "adj-i": ADJ_I, "adj-na": ADJ, "vs": VS, "vk": VK, "vz": VZ, "v_ar": V | V_AR, "v_er": V | V_ER, "v_ir": V | V_IR, "v.refl": V | REFLEXIVE, "v.sep": V, "vm": V}

_DOUBLED = "b d g l m n p r t".split()
_AR = "o as a amos áis an aba abas ábamos abais aban é aste ó asteis aron aré arás ará aremos aréis arán aría arías aríamos aríais arían e es emos éis en ando ado ada ados adas ara aras áramos arais aran ase ases ásemos aseis asen ad"
_ER_IR = "o es e en a as amos áis an ía ías íamos íais ían í iste ió isteis ieron iendo ido ida idos idas iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen"
_FUTURE = "é ás á emos éis án ía ías íamos íais ían"
_ROW = {"う": "わいえお", "つ": "たちてと", "る": "らりれろ", "く": "かきけこ", "ぐ": "がぎげご", "す": "さしせそ", "ぬ": "なにねの", "ぶ": "ばびべぼ", "む": "まみめも"}
_TE = {"う": "って", "つ": "って", "る": "って", "く": "いて", "ぐ": "いで", "す": "して", "ぬ": "んで", "ぶ": "んで", "む": "んで"}
# Fixed values, our own tables of endings: language, shown as, cond_in, cond_out, pairs "ending>ending of the base form".
PARADIGMS = [
    ("en", "plural", 0, N, "s> es> ies>y ves>f ves>fe"),
    ("en", "3rd person", 0, V, "s> es> ies>y"),
    ("en", "past", 0, V, "ed> ed>e ied>y " + " ".join(f"{c}{c}ed>{c}" for c in _DOUBLED)),
    ("en", "-ing", 0, V, "ing> ing>e ying>ie " + " ".join(f"{c}{c}ing>{c}" for c in _DOUBLED)),
    ("en", "comparative", 0, ADJ, "er> er>e ier>y " + " ".join(f"{c}{c}er>{c}" for c in _DOUBLED)),
    ("en", "superlative", 0, ADJ, "est> est>e iest>y " + " ".join(f"{c}{c}est>{c}" for c in _DOUBLED)),
    ("en", "-ly", 0, ADJ, "ly> ily>y ly>le"),
    ("en", "-ness", N, ADJ, "ness> iness>y"),
    ("en", "agent", N, V, "er> er>e ier>y or> or>e"),
    ("en", "-able", ADJ, V, "able> able>e iable>y"),
    ("en", "-ful", ADJ, N, "ful> iful>y"),
    ("en", "-less", ADJ, N, "less> iless>y"),
    ("en", "-ish", ADJ, N, "ish>"),
    ("de", "plural", 0, N, "e> en> n> er> s> nen> se>"),
    ("de", "dative plural", 0, N, "ern> en>e"),
    ("de", "genitive", 0, N, "s> es> ns>"),
    ("de", "present", 0, V, "e>en st>en t>en est>en et>en le>eln lst>eln lt>eln re>ern rst>ern rt>ern"),
    ("de", "past", 0, V, "te>en test>en ten>en tet>en ete>en etest>en eten>en etet>en"),
    ("de", "participle", 0, V, "end> ende> ender> endes> enden>"),
    ("de", "adjective", 0, ADJ, "e> er> es> em> en>"),
    ("de", "comparative", ADJ, ADJ, "er> ere> erer> eres> erem> eren>"),
    ("de", "superlative", ADJ, ADJ, "ste> sten> ster> stes> stem> este> esten>"),
    ("de", "-ung", N, V, "ung>en"),
    ("de", "-heit", N, ADJ, "heit> keit>"),
    ("de", "-chen", N, N, "chen> lein>"),
    ("es", "plural", 0, N | ADJ, "s> es> ces>z"),
    ("es", "feminine", 0, ADJ, "a>o as>o"),
    ("es", "-mente", 0, ADJ, "mente> amente>o"),
    ("es", "diminutive", N | ADJ, N | ADJ, "ito>o ita>a itos>os itas>as illo>o illa>a"),
    ("es", "-ar", REFLEXIVE, V | V_AR, " ".join(f"{e}>ar" for e in _AR.split())),
    ("es", "-er", REFLEXIVE, V | V_ER, " ".join(f"{e}>er" for e in [*_ER_IR.split(), "emos", "éis", "imos", "ed", *("er" + e for e in _FUTURE.split())])),
    ("es", "-ir", REFLEXIVE, V | V_IR, " ".join(f"{e}>ir" for e in [*_ER_IR.split(), "imos", "ís", "id", *("ir" + e for e in _FUTURE.split())])),
    ("es", "with pronoun", 0, V | REFLEXIVE, " ".join(f"r{p}>r ándo{p}>ando éndo{p}>endo" for p in "me te se lo la le nos os los las les".split())),
    ("fr", "plural", 0, N | ADJ, "s> x> aux>al eaux>eau"),
    ("fr", "feminine", N | ADJ, ADJ, "e> ive>if euse>eux euse>eur trice>teur elle>el enne>en ère>er"),
    ("fr", "-ment", 0, ADJ, "ment> ement> amment>ant emment>ent"),
    ("fr", "-er", N | ADJ, V | V_ER, " ".join(f"{e}>er" for e in "e es ons ez ent ais ait ions iez aient ai as a âmes âtes èrent erai eras era erons erez eront erais erait erions eriez eraient é ée és ées ant asse asses".split())),
    ("fr", "-ir", N | ADJ, V | V_IR, " ".join(f"{e}>ir" for e in "is it issons issez issent issais issait issions issiez issaient irai iras ira irons irez iront irais irait irions iriez iraient i ie ies issant isse isses".split())),
    ("fr", "-re", N | ADJ, V, " ".join(f"{e}>re" for e in "s ons ez ent ais ait ions iez aient is it irent rai ras ra rons rez ront rais rait rions riez raient u ue us ues ant e es".split())),
    ("ru", "case", 0, N, "а> у> ом> е> ы> и> ов> ам> ами> ах> ы>а и>а е>а у>а ой>а ою>а ам>а ами>а ах>а и>ь я>ь ю>ь ем>ь ём>ь е>ь ей>ь ям>ь ями>ь ях>ь и>я е>я ю>я ей>я ям>я ями>я ях>я а>о у>о ом>о ам>о ами>о ах>о и>й я>й ю>й ем>й ев>й"),
    ("ru", "adjective", 0, ADJ, " ".join(f"{e}>ый {e}>ой" for e in "ого ому ым ом ая ую ой ое ые ых ыми".split()) + " " + " ".join(f"{e}>ий" for e in "его ему им ем яя юю ей ее ие их ими ого ому ом ая ую ой ое".split())),
    ("ru", "-ость", N, ADJ, "ость>ый ость>ий"),
    ("ru", "-о", 0, ADJ, "о>ый о>ий"),
    ("ru", "reflexive", 0, REFLEXIVE, "ся> сь>"),
    ("ru", "past", REFLEXIVE, V, "л>ть ла>ть ло>ть ли>ть"),
    ("ru", "present", REFLEXIVE, V, "ю>ть ешь>ть ет>ть ем>ть ете>ть ют>ть ю>ить у>ить ишь>ить ит>ить им>ить ите>ить ят>ить ат>ить"),
    ("ru", "participle", ADJ, V, "вший>ть ющий>ть ящий>ить нный>ть"),
    ("ja", "negative", ADJ_I, V5, " ".join(f"{s[0]}ない>{u}" for u, s in _ROW.items())),
    ("ja", "polite", POLITE, V5, " ".join(f"{s[1]}ます>{u}" for u, s in _ROW.items())),
    ("ja", "stem", 0, V5, " ".join(f"{s[1]}>{u} {s[1]}ながら>{u}" for u, s in _ROW.items())),
    ("ja", "-tai", ADJ_I, V5, " ".join(f"{s[1]}たい>{u}" for u, s in _ROW.items())),
    ("ja", "-te", TE, V5, " ".join(f"{t}>{u}" for u, t in _TE.items())),
    ("ja", "past", 0, V5, " ".join(f"{t[:-1]}{'た' if t[-1] == 'て' else 'だ'}>{u}" for u, t in _TE.items())),
    ("ja", "potential", V1, V5, " ".join(f"{s[2]}る>{u}" for u, s in _ROW.items())),
    ("ja", "passive", V1, V5, " ".join(f"{s[0]}れる>{u}" for u, s in _ROW.items())),
    ("ja", "causative", V1, V5, " ".join(f"{s[0]}せる>{u}" for u, s in _ROW.items())),
    ("ja", "volitional", 0, V5, " ".join(f"{s[3]}う>{u}" for u, s in _ROW.items())),
    ("ja", "imperative", 0, V5, " ".join(f"{s[2]}>{u}" for u, s in _ROW.items())),
    ("ja", "-ba", 0, V5, " ".join(f"{s[2]}ば>{u}" for u, s in _ROW.items())),
    ("ja", "negative", ADJ_I, V1, "ない>る"),
    ("ja", "polite", POLITE, V1, "ます>る"),
    ("ja", "stem", 0, V1, "ながら>る"),
    ("ja", "-tai", ADJ_I, V1, "たい>る"),
    ("ja", "-te", TE, V1, "て>る"),
    ("ja", "past", 0, V1, "た>る"),
    ("ja", "passive", V1, V1, "られる>る"),
    ("ja", "causative", V1, V1, "させる>る"),
    ("ja", "volitional", 0, V1, "よう>る"),
    ("ja", "imperative", 0, V1, "ろ>る よ>る"),
    ("ja", "-ba", 0, V1, "れば>る"),
    ("ja", "adverb", 0, ADJ_I, "く>い くて>い"),
    ("ja", "past", 0, ADJ_I, "かった>い"),
    ("ja", "-ba", 0, ADJ_I, "ければ>い"),
    ("ja", "-sa", N, ADJ_I, "さ>い"),
    ("ja", "negative", ADJ_I, ADJ_I, "くない>い"),
    ("ja", "polite past", 0, POLITE, "ました>ます"),
    ("ja", "polite negative", 0, POLITE, "ません>ます"),
    ("ja", "polite volitional", 0, POLITE, "ましょう>ます"),
    ("ja", "-te iru", V1, TE, "ている>て でいる>で てる>て でる>で"),
    ("ja", "-te shimau", V5, TE, "てしまう>て でしまう>で"),
    ("ja", "-te oku", V5, TE, "ておく>て でおく>で"),
    ("ja", "-te miru", V1, TE, "てみる>て でみる>で"),
    ("ja", "suru", 0, VS, "して>する した>する しよう>する しろ>する すれば>する"),
    ("ja", "suru negative", ADJ_I, VS, "しない>する"),
    ("ja", "suru polite", POLITE, VS, "します>する"),
    ("ja", "suru passive", V1, VS, "される>する させる>する できる>する"),
]


def _spelled(paradigms: Sequence[tuple]) -> tuple[tuple, ...]:
    """The rules (id, language, suffix in, suffix out, cond_in, cond_out, shown as) of the paradigms; ids are language:form:ending>base."""
    made = {}
    for lang, shown, cond_in, cond_out, pairs in paradigms:
        for given, _, left in (p.partition(">") for p in pairs.split()):
            rule_id = f"{lang}:{shown}:{given}>{left}"
            known = made.get(rule_id)
            made[rule_id] = (rule_id, lang, given, left, cond_in | (known[4] if known else 0), cond_out | (known[5] if known else 0), shown)
    return tuple(made.values())


RULES = _spelled(PARADIGMS)


def check_rules(rules: Sequence[tuple]) -> None:
    """Proves that chains of the rules end, or raises ValueError.

    A rule that can follow steps that it leads back to (by the bits of cond_in and cond_out) must not lengthen a text, and those of them that keep the length
    must not form a cycle: then every round makes the text shorter, and outside of such rounds each rule is used once at most.
    """
    if bad := [r for r in rules if not r[2] or not r[5]]:
        raise ValueError(f"a rule needs a suffix and leaves a condition: {bad[:3]}")

    def follows(these: Sequence[tuple]) -> dict[int, set[int]]:
        return {i: {j for j, b in enumerate(these) if a[1] == b[1] and a[5] & b[4]} for i, a in enumerate(these)}

    def closure(edges: dict[int, set[int]]) -> dict[int, set[int]]:
        reach = {i: set(n) for i, n in edges.items()}
        changed = True
        while changed:
            changed = False
            for i, n in reach.items():
                more = set().union(*(reach[j] for j in n)) - n if n else set()
                changed |= bool(more)
                n |= more
        return reach

    # Rules alike in language, conditions and change of length behave alike, so one of each is looked at.
    kinds = list({(r[1], r[4], r[5], (len(r[3]) > len(r[2])) - (len(r[3]) < len(r[2]))): r for r in rules if r[4]}.values())
    reach = closure(follows(kinds))
    loops = [r for i, r in enumerate(kinds) if i in reach[i]]
    if long := [r for r in loops if len(r[3]) > len(r[2])]:
        raise ValueError(f"chains of these rules may not end: {long[:3]}")
    level = [r for r in loops if len(r[3]) == len(r[2])]
    again = closure(follows(level))
    if found := [r for i, r in enumerate(level) if i in again[i]]:
        raise ValueError(f"chains of these rules may not end: {found[:3]}")


check_rules(RULES)


def rule_flags(rules: Column) -> Column:
    """The condition bits of an array of rule names; unknown names have none."""
    bits = F.transform(rules, lambda r: reduce(lambda out, kv: F.when(r == kv[0], F.lit(kv[1]).cast("bigint")).otherwise(out), CONDITIONS.items(), F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))


def as_candidates(texts: DataFrame, text: str, per: Sequence[str]) -> DataFrame:
    """Each text as its own candidate: conditions 0 and no rules. Also the whole result where de-inflection is off."""
    return texts.where(F.col(text) != "").select(*per, F.col(text).alias("original"), F.col(text).alias("deinflected"), F.lit(0).cast("bigint").alias("conditions"), F.array().cast("array<string>").alias("rules"))


def _chains(rules: Sequence[tuple]):
    """(text, language) to all its (text, conditions, rule ids, the last applied first), itself included."""
    by: dict[str, dict[str, list[tuple]]] = {}
    for rule_id, lang, given, left, cond_in, cond_out, _ in rules:
        by.setdefault(lang, {}).setdefault(given, []).append((left, cond_in, cond_out, rule_id))
    longest = {lang: max(map(len, table)) for lang, table in by.items()}

    def chains(text: str, lang: str | None) -> list[tuple[str, int, tuple[str, ...]]]:
        out = level = [(text, 0, ())]
        table = by.get(lang or "")
        while table and level:
            further = []
            for given, cond, ids in level:
                for n in range(1, min(longest[lang], len(given)) + 1):
                    for left, cond_in, cond_out, rule_id in table.get(given[-n:], ()):
                        if (not ids or cond & cond_in) and (made := given[:-n] + left):
                            further.append((made, cond_out, (rule_id, *ids)))
            out, level = out + further, further
        return out

    return chains


def deinflections(candidates: DataFrame, lang: str, rules: Sequence[tuple] = RULES) -> DataFrame:
    """The candidates (deinflected, conditions 0, rules empty) and all that chains of rules of any length make of them; chains that would leave nothing are not applied.

    No expression of the JVM goes on until nothing is left to do, so the steps run on Arrow batches, without a shuffle. Give distinct texts:
    they are the vocabulary, not the corpus. The rules are the size of their table. Null texts and unknown languages have no chains.
    """
    if rules is not RULES:
        check_rules(rules)

    def made(texts: pa.Array, langs: pa.Array) -> pa.Array:
        chains = _chains(rules)
        found = [chains(t, g) if t is not None else [] for t, g in zip(texts.to_pylist(), langs.to_pylist(), strict=True)]
        flat = [c for row in found for c in row]
        ends = [0]
        for row in found:
            ends.append(ends[-1] + len(row))
        ids = pa.array([c[2] for c in flat], pa.list_(pa.string()))
        items = pa.StructArray.from_arrays([pa.array([c[0] for c in flat], pa.string()), pa.array([c[1] for c in flat], pa.int64()), ids], ["deinflected", "conditions", "rules"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    every = arrow_udf(made, "array<struct<deinflected:string,conditions:bigint,rules:array<string>>>")(F.col("deinflected"), F.col(lang))
    rows = candidates.withColumn("_c", F.explode(every))
    return rows.select(*(F.col(f"_c.{c}").alias(c) if c in ("deinflected", "conditions", "rules") else c for c in candidates.columns))


def _tails(rules: Sequence[tuple]) -> tuple[set[str], set[str]]:
    """What chains of these rules take off a text: the suffix of the first rule, and before it, in any number, the parts of the further suffixes that no
    rule has put there. The states are what the rules so far have put at the end and the conditions they leave; they are few, as no loop lengthens."""
    states = {(r[3], r[5]) for r in rules}
    todo, parts = list(states), set()
    while todo:
        put, cond = todo.pop()
        for _, _, given, left, cond_in, cond_out, _ in rules:
            if cond & cond_in and (given.endswith(put) or put.endswith(given)):
                parts.add(given[: len(given) - len(put)] if given.endswith(put) else "")
                state = (left if given.endswith(put) else put[: len(put) - len(given)] + left, cond_out)
                if state not in states:
                    states.add(state)
                    todo.append(state)
    return {r[2] for r in rules}, parts - {""}


def inflected_prefixes(text: Column, lang: Column, most: Column, bare: bool, rules: Sequence[tuple] = RULES) -> Column:
    """The prefixes of a text that can become a key that shares at most its first `most` characters, as an array: those characters and
    what chains of rules can take off after any of them. bare: whether a key may share none. In ja katakana counts as hiragana.

    Runs on Arrow batches: what can be taken off is found by going on from every place that is reached, in one pass.
    """
    tails = {g: _tails([r for r in rules if r[1] == g]) for g in {r[1] for r in rules}}
    widths = {g: (max(map(len, first)), max(map(len, parts), default=0)) for g, (first, parts) in tails.items()}
    hiragana = {0x30A1 + i: 0x3041 + i for i in range(0x56)}

    def ends(t: str, g: str, most: int) -> set[int]:
        out = set(range(1, min(most, len(t)) + 1))
        if g in tails:
            (first, parts), (wide, narrow), t = tails[g], widths[g], t.translate(hiragana) if g == "ja" else t
            places = set(range(0 if bare else 1, min(most, len(t)) + 1))
            for at in range(len(t)):
                if at in places:
                    out |= {at + n for n in range(1, wide + 1) if t[at : at + n] in first and at + n <= len(t)}
                    places |= {at + n for n in range(1, narrow + 1) if t[at : at + n] in parts and at + n <= len(t)}
        return out

    def found(texts: pa.Array, langs: pa.Array, mosts: pa.Array) -> pa.Array:
        known: dict[tuple, list[str]] = {}  # of one batch: short texts recur
        rows = list(zip(texts.to_pylist(), langs.to_pylist(), mosts.to_pylist(), strict=True))
        for t, g, m in set(rows):
            known[t, g, m] = [t[:n] for n in ends(t, g or "", m or 0)]
        return pa.array([known[r] for r in rows], pa.list_(pa.string()))

    return arrow_udf(found, "array<string>")(text, lang, most)


#: What is read of a glossary to know whose form a term is.
FORMS = "array<struct<kind:string,form_of:string,rules:array<string>>>"


def passes_pos(conditions: Column, flags: Column, pos_filter: Column) -> Column:
    """The part-of-speech filter of a dictionary: candidates without conditions pass, others must share a bit with the entry."""
    return ~F.coalesce(pos_filter, F.lit(False)) | (conditions == 0) | (conditions.bitwiseAND(flags) != 0)


def display_rules(rules: Column, table: Sequence[tuple] = RULES) -> Column:
    """The rule ids as users see them; unknown ids stay."""
    shown = F.create_map(*(F.lit(x) for r in table for x in (r[0], r[6])))
    return F.transform(rules, lambda r: F.coalesce(F.try_element_at(shown, r), r))


def is_content(glossary: Column) -> Column:
    return F.filter(glossary, lambda g: g["kind"] == "Content")


def only_content(rows: DataFrame) -> DataFrame:
    """Glossaries without their Deinflection items; rows left without content are dropped."""
    return rows.withColumn("glossary", is_content(F.col("glossary"))).where(F.size("glossary") > 0)


def _by_key(terms: DataFrame) -> DataFrame:
    return terms.withColumn("key", F.explode(F.array_distinct(F.array("expression", "reading")))).where("key <> ''")


def forms_said(terms: DataFrame) -> DataFrame:
    """(_k, _flags, _filter, _form_of, _rules), distinct: the keys whose rows say "form of x" in a glossary (see `keyed_lexicon`)."""
    forms = F.filter("forms" if "forms" in terms.columns else "glossary", lambda g: (g["kind"] == "Deinflection") & (g["form_of"] != ""))
    said = _by_key(terms.where("use_deinflections")).select(F.col("key").alias("_k"), F.col("flags").alias("_flags"), F.col("parts_of_speech_filter").alias("_filter"), F.explode(forms).alias("_form"))
    return said.select("_k", "_flags", "_filter", F.col("_form.form_of").alias("_form_of"), F.coalesce("_form.rules", F.array().cast("array<string>")).alias("_rules")).distinct()


def keyed_lexicon(terms: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """The lexicon by lookup key, dictionary hops resolved: the rows of terms with key, key_flags, key_pos_filter and hop.

    A row stands under its expression and its reading. Where a row's glossary says "form of x", the rows of x stand under
    its keys as well, with the flags and the filter of the row that says so, and hop holds that item's rules; else hop is null. terms has
    a glossary (or its items' kind, form_of and rules as forms), flags, parts_of_speech_filter and use_deinflections; null and empty keys are left out. The hop is joined once, on the
    lexicon, not once per query. said: `forms_said` of the rows that tell of forms, if terms are others.
    """
    keyed = _by_key(terms)
    direct = keyed.withColumns({"key_flags": F.col("flags"), "key_pos_filter": F.col("parts_of_speech_filter"), "hop": F.lit(None).cast("array<string>")})
    said = forms_said(terms) if said is None else said
    hopped = keyed.join(said, F.col("key") == F.col("_form_of"))
    hopped = hopped.select(*(c for c in keyed.columns if c != "key"), F.col("_k").alias("key"), F.col("_flags").alias("key_flags"), F.col("_filter").alias("key_pos_filter"), F.col("_rules").alias("hop"))
    return direct.unionByName(hopped)
