"""Column expressions over text.  All are built-in JVM expressions, no UDFs.

Java's ``\\s``/``\\w``/``\\b`` are ASCII unless UNICODE_CHARACTER_CLASS is on, so every
pattern gets ``(?U)`` and, where the pack says so, ``(?i)``.
"""

import re

from pyspark.sql import functions as F

from paperlens import packs


def ci(pattern):
    return "(?iU)" + pattern


def cs(pattern):
    return "(?U)" + pattern


def any_of(patterns):
    return "|".join(f"(?:{p})" for p in patterns)


HAN = "[一-鿿]"


def alternatives(pattern):
    """Top-level alternatives of a pattern; a group around the whole pattern is opened first."""

    def split(p):
        out, depth, in_class, i, last = [], 0, False, 0, 0
        while i < len(p):
            c = p[i]
            if c == "\\":
                i += 1
            elif in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0 and i < len(p) - 1 and not out and last == 0:
                    split.whole = False
            elif c == "|" and depth == 0:
                out.append(p[last:i])
                last = i + 1
            i += 1
        return [*out, p[last:]]

    parts = []
    for part in split(pattern):
        split.whole = part.startswith("(") and part.endswith(")")
        split(part)
        inner = re.sub(r"^\((\?:)?", "", part)[:-1] if split.whole else None
        parts.extend(alternatives(inner) if inner is not None and not inner.startswith("?") else [part])
    return parts


def first_class(alternative):
    """Regex class of the characters a match can start with, or None when that is not plain to see."""
    p = alternative.removeprefix(r"\b")
    m = re.match(r"(\\d|\[[^\]\\^-]+\]|[^\\\[\](){}.*+?|^$])(.?)", p)
    if not m or m.group(2) in ("?", "*", "{"):
        return None
    return m.group(1)


def any_of_by_first(patterns):
    """The union of the patterns, alternatives grouped under a look-ahead on their first character.

    Same language as ``any_of``; where a text matches nothing, most positions fail on the
    look-aheads instead of on every alternative.
    """
    groups = {}
    for p in patterns:
        for alt in alternatives(p):
            groups.setdefault(first_class(alt), []).append(alt)
    loose = groups.pop(None, [])
    parts = [f"(?={c})(?:{'|'.join(alts)})" for c, alts in groups.items()] + loose
    return "|".join(f"(?:{x})" for x in parts)


#: Characters besides its two cases that Java's Unicode case folding takes for a letter.
_ALSO = {"i": "ıİ", "k": "K", "s": "ſ"}


def cases(c, ignore_case):
    """A pattern of a character that matches as the character itself would; the cases are spelled out."""
    both = c.lower() + c.upper()
    return f"(?-i:[{both}{_ALSO.get(c.lower(), '')}])" if ignore_case and len(set(both)) == 2 else c


def by_first(c, alts, ignore_case):
    """Alternatives that begin with the character `c`, after a word border or not, as a tree over their first two characters.

    A character that is consumed costs a fraction of a look-ahead on it, as that is a group to the engine.
    """

    def as_is(p):
        plain = ignore_case and p and not re.search(r"[^\W\d_一-鿿]", re.sub(r"\\[a-zA-Z]", "", p))
        return f"(?-i:{p})" if plain else p

    def union(parts):
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    seconds, rest = {}, []
    for alt in alts:
        border = r"(?<=\b{})" if alt.startswith(r"\b") else ""
        tail = alt.removeprefix(r"\b")[1:]
        if re.match(rf"(?:[a-zA-Z0-9]|{HAN})(?![?*+{{])", tail):
            s = tail[0].lower() if ignore_case else tail[0]
            seconds.setdefault(s, []).append(border.format(cases(c, ignore_case) + cases(s, ignore_case)) + as_is(tail[1:]))
        else:
            rest.append(border.format(cases(c, ignore_case)) + as_is(tail))
    return cases(c, ignore_case) + union([cases(s, ignore_case) + union(tails) for s, tails in seconds.items()] + rest)


def _one_of(chars):
    return f"[{''.join(map(re.escape, sorted(chars)))}]"


#: Han characters of one class; the engine tries the characters of such a class one by one.
_CLASS = 8


def _ranges(tree, ahead):
    """The alternatives of a tree, Han character by Han character; a place fails on ranges of them, then on a few characters."""
    han, parts = sorted(tree), []
    for i in range(0, len(han), _CLASS):
        group = han[i : i + _CLASS]
        within = ahead(f"{group[0]}-{group[-1]}") if len(han) > _CLASS else ""
        parts.append(within + ahead("".join(group)) + f"(?:{'|'.join(tree[c] for c in group)})")
    return "|".join(parts)


def gated(patterns, ignore_case=False):
    """The union of the patterns as a tree over the first characters of its alternatives.

    Same language as ``any_of``.  At most positions of a text one look into a character class fails instead of every
    alternative; both cases of a letter are spelled out, as folding case is what costs most.  Alternatives that begin alike
    keep their order, so that matches are the same as well unless an alternative has no two plain characters at its beginning.
    """
    han, letters, rest, loose = {}, {}, {}, []
    for alt in (a for p in patterns for a in alternatives(p)):
        c = first_class(alt)
        if c is None or re.match(r".\+", alt.removeprefix(r"\b")):
            loose.append(alt)
        elif re.fullmatch(HAN, c):
            han.setdefault(c, []).append(alt)
        elif len(c) == 1 and c.isalpha() and len(c.lower() + c.upper()) == 2:
            letters.setdefault(c.lower() if ignore_case else c, []).append(alt)
        else:
            rest.setdefault(c, []).append(alt)
    ahead = (lambda c: f"(?-i)(?=[{c}])(?i)") if ignore_case else (lambda c: f"(?=[{c}])")
    trees = [_ranges({c: by_first(c, alts, ignore_case) for c, alts in han.items()}, ahead), "|".join(by_first(c, alts, ignore_case) for c, alts in letters.items())]
    firsts = "".join(c + c.swapcase() + _ALSO.get(c, "") if ignore_case else c for c in letters)
    parts = [f"{ahead(HAN[1:-1])}(?:{trees[0]})"] * bool(han) + [trees[1]] * bool(letters) + [f"(?={c})(?:{'|'.join(alts)})" for c, alts in rest.items()]
    if loose or (ignore_case and any(re.search("[^\\W\\d_]", c.replace(r"\d", "")) for c in rest)):
        return "|".join(parts + loose)
    others = "".join(c if len(c) > 1 else re.escape(c) for c in rest)
    return ahead(HAN[1:-1] * bool(han) + firsts + others) + f"(?:{'|'.join(parts)})"


def needs_han(pattern):
    """Must every match hold a Han character?  Inner groups are folded to a Han mark or to nothing."""
    flat = re.sub(r"\[[^\]]*\]", "", pattern)
    group = re.compile(r"\((?:\?:)?([^()]*)\)([?*]?)")

    def plain(p):
        return all(re.search(HAN, re.sub(r"[^\\][?*]", "", alt)) for alt in p.split("|"))

    while group.search(flat):
        flat = group.sub(lambda m: "一" if not m.group(2) and plain(m.group(1)) else "", flat, count=1)
    return plain(flat)


#: Letters from the most to the least frequent ones in texts of Latin script; any other character counts as rarer.
_FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


def _rare(c):
    at = _FREQUENT.find(c.lower())
    return len(_FREQUENT) if at < 0 else at


def _group(p, i):
    """The end of the group or class that opens at `i`."""
    depth, in_class = 0, False
    while True:
        if p[i] == "\\":
            i += 1
        elif in_class:
            in_class = p[i] != "]"
        elif p[i] == "[":
            in_class = True
        elif p[i] in "()":
            depth += 1 if p[i] == "(" else -1
        i += 1
        if depth == 0 and not in_class:
            return i


def needed(alternative):
    """Plain texts in lower case, one of which every match of the alternative holds on one line, be it in other case; a text
    that only counts behind a word border begins with one.  None when that is not plain to see."""
    found, run, i, p = [], "", 0, alternative

    def close():
        bare = run.removeprefix(r"\b")
        if bare:
            found.append((min(4, len(bare)) * 10 + sum(sorted(map(_rare, bare))[-4:]) - 60 * (bare in ".,"), [run if len(bare) < 4 else bare]))

    while i < len(p):
        c, literal = p[i], None
        if c in "^$|*+?{}":
            return None
        if c == "\\":
            j = i + 2
            if p[i + 1] in "pPxukQ0123456789":
                return None
            literal = None if p[i + 1].isalnum() else p[i + 1]
        elif c in "[(":
            j = _group(p, i)
        else:
            j, literal = i + 1, None if c in ". " else c.lower()
        more = re.match(r"[*?+]|\{\d+(?:,\d*)?\}", p[j:])
        optional = more and (more[0] in "*?" or more[0].startswith("{0"))
        if literal and not optional:
            run += literal
        if not literal or more:
            close()
            run = r"\b" if p[i:j] == r"\b" else ""
        if c == "[" and not optional and re.fullmatch(r"\[[<=>:±]+\]", p[i:j]):
            found.append((30 + len(_FREQUENT), list(p[i + 1 : j - 1])))
        if c == "(":
            inner = re.sub(r"^\((?:\?:)?", "", p[i:j])[:-1]
            if inner.startswith("?"):
                return None
            parts = [] if optional else [needed(a) for a in alternatives(inner)]
            if parts and all(parts):
                found.append((min(min(4, len(x)) * 10 + sum(sorted(map(_rare, x))[-4:]) for part in parts for x in part) + 1, sum(parts, [])))
        i = j + len(more[0]) + (p[j + len(more[0]) : j + len(more[0]) + 1] in ("?", "+")) if more else j
    close()
    return max(found)[1] if found else None


def seeds(patterns):
    """A pattern for lower-cased lines, and letters beyond one byte: where neither hits on any line, no pattern hits without
    a Han character.  (None, "") when that is not plain to see.

    Each text is looked for by its rarest letter with the next one, and what goes before is looked back at, so that at most
    positions two classes fail.
    """
    plain = [needed(a) for p in patterns for a in alternatives(p) if not needs_han(a)]
    if not plain or not all(plain):
        return None, ""
    texts = sorted(set(sum(plain, [])))
    wide = "".join(sorted({x for t in texts for c in t if ord(c) > 255 for x in (c, c.upper())}))
    trees, signs = {}, ""
    for t in texts:
        bare = t.removeprefix(r"\b")
        if any(ord(c) > 255 for c in bare):
            continue
        if len(bare) == 1:
            signs += bare
            continue
        k = max(range(len(bare) - 1), key=lambda k: (_rare(bare[k]), _rare(bare[k + 1])))
        before = (r"\b" if bare != t else "") + re.escape(bare[:k])
        back = f"(?<={before}{re.escape(bare[k : k + 2])})" if before else ""
        trees.setdefault(bare[k], {}).setdefault(bare[k + 1], []).append(back + re.escape(bare[k + 2 :]))
    union = lambda parts: parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    parts = []
    for half in ([a for a in trees if _rare(a) >= 10], [a for a in trees if _rare(a) < 10]):
        if half:
            ahead = _one_of(half) + _one_of({b for a in half for b in trees[a]})
            parts.append(f"(?={ahead}){union([re.escape(a) + union([re.escape(b) + union(ends) for b, ends in trees[a].items()]) for a in half])}")
    return cs("|".join(parts + [_one_of(signs)] * bool(signs))), wide


def _by_first(texts):
    """The plain texts as a tree over their first characters, the longest of a character first; Han characters by ranges."""
    firsts, seconds = {}, set()
    for t in sorted(texts, key=lambda t: (-len(t.removeprefix(r"\b")), t)):
        bare = t.removeprefix(r"\b")
        firsts.setdefault(bare[0], []).append((rf"(?<=\b{re.escape(bare[0])})" if bare != t else "") + re.escape(bare[1:]))
        if bare[0].isascii():
            seconds.add(bare[1:2])
    tree = {c: re.escape(c) + (ends[0] if len(ends) == 1 else f"(?:{'|'.join(ends)})") for c, ends in firsts.items()}
    signs = [c for c in tree if "" in firsts[c]]  # texts of one character
    han = sorted(c for c in tree if re.fullmatch(HAN, c))
    letters = sorted(c for c in tree if c.isascii() and c not in signs)
    parts = [tree[c] for c in tree if c not in han and c not in letters]
    if han:
        parts.append(f"(?={HAN})(?:{_ranges({c: tree[c] for c in han}, lambda c: f'(?=[{c}])')})")
    if letters:
        parts.append(f"(?={_one_of(letters)}{_one_of(seconds - {''})})(?:{'|'.join(tree[c] for c in letters)})")
    firsts = "".join(c for c in tree if c not in han and not c.isascii()) + _one_of(c for c in tree if c.isascii())[1:-1]
    return f"(?=[{HAN[1:-1] * bool(han)}{firsts}])(?:{'|'.join(parts)})"


def triggers(patterns):
    """(pattern, table): the texts that the first group finds at every place of a lower-cased text, and what kinds each of them
    may announce; a kind that none announces does not hit.  None when that is not plain to see."""
    announced = {}
    for kind, ps in patterns.items():
        for alt in (a for p in ps for a in alternatives(p)):
            texts = needed(alt)
            if not texts:
                return None
            for t in texts:
                announced.setdefault(t, []).append(kind)
    bare = {t: t.removeprefix(r"\b") for t in announced}
    # at a place the longest text is found, which stands for those that it begins with
    table = {b: list(dict.fromkeys(k for t, x in bare.items() if b.startswith(x) for k in announced[t])) for b in sorted(set(bare.values()))}
    return cs(f"(?=({_by_first(announced)}))"), table


#: Characters of a line without seeds that a hit begun or ended on another line may reach, beside blanks; the signals'
#: longest gap is 24, their words are shorter.
REACH = 26


def shortened(line, worth):
    """The line, or its ends when it has no seed: hits of the signals within the joined lines stay as they are.

    The full stop between the ends is in none of the gaps that signals allow; a line with blanks at its ends is left whole.
    """
    ends = F.concat(F.left(line, F.lit(1)), F.right(line, F.lit(1)))
    cut = ~worth & (F.length(line) > 2 * REACH) & ~ends.rlike(cs(r"\s"))
    return F.when(cut, F.concat(F.left(line, F.lit(REACH)), F.lit("。"), F.right(line, F.lit(REACH)))).otherwise(line)


def signal(col, name):
    """Does a signal pattern hit; patterns that need a Han character are tried only where there is one."""
    pattern = packs.SIGNALS[name][0]
    hit = col.rlike(signal_pattern(name))
    return col.rlike(HAN) & hit if needs_han(pattern) else hit


def signal_pattern(name):
    pattern, ignore_case = packs.SIGNALS[name]
    return (ci if ignore_case else cs)(gated([pattern], ignore_case))


def literal_map(table):
    """Constant map column written as one SQL literal."""
    lit = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else (f"array({', '.join(map(lit, v))})" if isinstance(v, list) else repr(v))
    return F.expr("map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items()) + ")")


#: What ``\\s`` stands for with UNICODE_CHARACTER_CLASS.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col):
    return F.btrim(col, F.lit(SPACES))


def is_blank(col):
    return ~col.rlike(cs(r"\S"))


def sentences(col):
    """Ordered non-blank sentences of a text (array<string>, stripped)."""
    pieces = F.transform(F.split(col, packs.SENTENCE_BREAK), strip)
    return F.filter(pieces, lambda s: F.length(s) > 0)


def sentence_spans(col):
    """array<struct<sent_idx,text,char_start,char_end>>: pieces zipped with their separators."""
    pieces = F.split(col, packs.SENTENCE_BREAK)
    seps = F.regexp_extract_all(col, F.lit(packs.SENTENCE_BREAK), F.lit(0))
    empty = F.array().cast("array<struct<text:string,char_start:int,char_end:int>>")
    walked = F.aggregate(
        F.arrays_zip(pieces.alias("piece"), seps.alias("sep")),
        F.struct(F.lit(0).alias("pos"), empty.alias("out")),
        lambda acc, z: F.struct(
            (acc["pos"] + F.length(z["piece"]) + F.length(F.coalesce(z["sep"], F.lit("")))).alias("pos"),
            F.array_append(
                acc["out"],
                F.struct(
                    strip(z["piece"]).alias("text"),
                    acc["pos"].alias("char_start"),
                    (acc["pos"] + F.length(z["piece"])).alias("char_end"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    kept = F.filter(walked, lambda s: F.length(s["text"]) > 0)
    return F.transform(
        kept,
        lambda s, i: F.struct(i.alias("sent_idx"), s["text"].alias("text"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end")),
    )


def language(col):
    han = F.length(F.regexp_replace(col, r"[^一-鿿]", ""))
    latin = F.length(F.regexp_replace(col, r"[^A-Za-z]", ""))
    return F.when(latin > han, "en").otherwise("zh")


def tokens(col):
    """Distinct lower-case ASCII words plus Han bigrams (a lone Han character is kept).

    Each step goes through a one-element array, so that the Han characters are found once, not once per bigram; a text of
    letters of one byte has none.
    """

    def grams(han):
        n = F.length(han)
        pairs = lambda cs: F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs) - 1), lambda a, b: F.concat(a, b))
        some = F.when(n == 1, F.array(han)).when(n >= 2, F.get(F.transform(F.array(F.split(han, "")), pairs), F.lit(0)))
        return some.otherwise(F.array().cast("array<string>"))

    def of(t):
        words = F.transform(F.regexp_extract_all(t, F.lit(packs.ASCII_WORD), F.lit(0)), lambda w: F.lower(w))
        han = F.when(F.octet_length(t) > F.length(t), F.regexp_replace(t, packs.NOT_HAN, "")).otherwise("")
        return F.array_distinct(F.concat(words, F.get(F.transform(F.array(han), grams), F.lit(0))))

    return F.get(F.transform(F.array(col), of), F.lit(0))


def squeeze(col):
    """Text without spaces and punctuation, lower-cased: the form quotes are matched in."""
    return F.lower(F.regexp_replace(col, cs(packs.QUOTE_NOISE), ""))


def clip(col, limit=packs.PROMPT_LIMIT, note=packs.PROMPT_CUT_NOTE):
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.left(col, F.lit(limit)), F.lit(note)))


def zh_number(col):
    """Arabic or Chinese numeral (一..九十九) to int; null when neither."""
    digit = F.translate(col, "一二三四五六七八九", "123456789")
    pos = F.instr(col, "十")
    n = F.length(col)
    return (
        F.when(col.rlike(r"^[0-9]+$"), col.try_cast("int"))
        .when(col == "十", F.lit(10))
        .when((n == 2) & (pos == 1), F.lit(10) + F.substr(digit, F.lit(2), F.lit(1)).try_cast("int"))
        .when((n == 2) & (pos == 2), F.substr(digit, F.lit(1), F.lit(1)).try_cast("int") * 10)
        .when(
            (n == 3) & (pos == 2),
            F.substr(digit, F.lit(1), F.lit(1)).try_cast("int") * 10 + F.substr(digit, F.lit(3), F.lit(1)).try_cast("int"),
        )
        .when(n == 1, digit.try_cast("int"))
    )


def redact(col, patterns=packs.REDACTIONS):
    for p in patterns:
        col = F.regexp_replace(col, p, packs.REDACTED)
    return col
