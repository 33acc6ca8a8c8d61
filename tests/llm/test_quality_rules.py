import re
from collections import Counter

from pitlake.llm import quality_rules

PROSE = "\n".join(f"On day{i} the late{i} harvest came{i}, and people{i} spoke{i} about it{i} with teacher{i} of village{i}." for i in range(8))
DOCS = [
    (1, PROSE), (2, None), (3, ""), (4, "same same same " * 40), (5, "\n".join(["Home | About | News | Contact | Help | More"] * 3 + [f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(20)])),
    (6, PROSE + "\nAll rights reserved.\nHome | News | Sport | Help | Login | About"), (7, " ".join(f"w{i}$$$" for i in range(80))), (8, "\n".join(f"Line {i % 4} is here again." for i in range(40))),
    (9, "\x0b".join(f"A{i}!! B{i}!! C{i}!!" for i in range(30)).upper()), (10, " ".join(f"w{i}" for i in range(200))), (1, PROSE), (None, PROSE), (11, "x" * 200_000),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def frame(spark, docs=DOCS):
    return spark.createDataFrame([(*d, len(d[1] or ""), "s") for d in docs], "doc_id long, text string, n_chars long, cleaned string")


def test_counts_equal_brute_force(spark):
    got = quality_rules.judged(frame(spark).repartition(3)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r.doc_id, *[r[n] for n in names]) for r in got], key=str) == sorted([(d, *brute(t)) for d, t in DOCS], key=str)
    assert all(not r.kept for r in got if r.base_failed)
    assert {r.doc_id for r in got if r.kept} == {1, 6, None}


def test_clean_documents_lose_nothing_and_others_their_failing_lines(spark):
    got = quality_rules.clean(frame(spark))
    assert got.columns == ["doc_id", "text", "n_chars", "cleaned"] and got.schema["n_chars"].dataType.simpleString() == "bigint"
    texts = {r.doc_id: r for r in got.collect()}
    assert texts[1].text == PROSE and texts[6].text == PROSE and texts[6].n_chars == len(PROSE) and got.count() == 4


def test_line_rules():
    fails = lambda line: quality_rules.line_fails(line, quality_rules.WORDS.findall(line))
    assert fails("Home | News | Sport | Help | About us") == "navigation" and fails("a$$$ b$$$ c$$$ d$$$ e$$$") == "symbols"
    assert fails("BUY!! NOW!! OR!! NEVER!! AGAIN!!") == "shouting" and fails("spam " * 30) == "repetition" and fails("Please enable JavaScript.") == "boilerplate"
    assert fails(" ".join(f"w{i}" for i in range(60))) == "punctuation" and fails("A short heading") is None and fails("Prices rose by 5% & more in May, they said.") is None


def test_every_separator_and_short_or_unended_lines():
    fails = lambda line, *after: quality_rules.line_fails(line, quality_rules.WORDS.findall(line), *after)
    for mark in ("|", ">", "»", "·", "•", "/", "::"):
        assert fails(f"Home {mark} News {mark} Sport {mark} Help {mark} About us") == "navigation" and fails(f"Home {mark} About") == "navigation"
    assert fails("home news sport weather travel culture money help contact about us") == "punctuation"
    assert fails("We met. then we went on and on with no end to it at all") == "punctuation"
    wrapped = "The boat left the harbour in the morning and the people"
    assert fails(wrapped, "waited for it at the pier.") is None and fails(wrapped) == "punctuation" and fails(wrapped, "Home") == "punctuation"
    for line in ("• one two three four", "« Oui » dit elle", "> quoted words", "He said that it was late and went home to \"sleep.\"", "Is this a line that ends in the right way?", "A heading of six plain words"):
        assert fails(line) is None
    menu = "\n".join(f"Home{i} » News{i}" for i in range(60))
    assert not quality_rules.judge(menu)[6]


def test_empty(spark):
    assert quality_rules.judged(frame(spark, [])).count() == 0 and quality_rules.clean(frame(spark, [])).count() == 0


def removed(text):
    kept = quality_rules.judge(text)[9].split("\n")
    return [x for x in text.split("\n") if x not in kept]


def test_wrapped_text_lists_and_headings_stay():
    german = "Am Morgen fuhr der alte Zug sehr langsam durch die große\nStadt und hielt an keinem der kleinen Bahnhöfe, weil\n1945 die Brücke gefallen war und niemand sie gebaut\n„Sofort“, sagte der Mann."
    names = "Every evening in the summer the letters were read by\nAnna Meyer, who kept them all in a box until the war\n\"ended\" and the house was sold to the town again."
    lists = "\n".join(f"{mark} the boat and the bread and the fish that Tom{i} found" for i, mark in enumerate(("-", "•", "3.", "(b)", "*")))
    head = "The long history of the river and the people of the valley\n\nThe river came down from the hills and the people of the valley lived by it."
    for text in (german, names, lists, head):
        assert removed(text) == [], text
    # no end mark below, a next word that had room, or no prose below: a run of words
    for text in ("The boat left the harbour in the morning and the people\nHome", "The boat left the harbour in the morning and the people\n\nHome News",
                 "Then we went on with no end to it at all and\nMore of it came along with them on the road to the sea in the morning, they said."):
        assert removed(text)[:1] == text.split("\n")[:1], text
    assert removed("Home News Sport Weather Travel Culture Money Help Contact About Us\n\nThe river came down from the hills and the people lived by it.")


def test_boilerplate_fills_its_line_in_four_languages():
    fails = lambda line: quality_rules.line_fails(line, quality_rules.WORDS.findall(line))
    for line in ("I had to sign up again.", "She could not read more.", "The mill is powered by water.", "Wir wollten nicht lange weiterlesen.", "Il voulait en savoir plus sur elle et sa ville.", "No quiso leer más aquella noche."):
        assert fails(line) is None, line
    for line in ("Alle Rechte vorbehalten", "© 2020 Maison Durand. Tous droits réservés.", "Todos los derechos reservados.", "Weiterlesen", "Lire la suite", "Haz clic aquí", "Cookies akzeptieren",
                 "Politique de confidentialité", "Jetzt anmelden", "Sign in", "Read more", "Click here to subscribe to news", "Copyright 2020 The Old Mill Company. All rights reserved."):
        assert fails(line) == "boilerplate", line


def test_cleaned_text_still_meets_the_base_rules():
    short = " ".join(f"w{i}" for i in range(48)) + "."
    got = quality_rules.judge(short + "\nHome | News | Sport")
    assert got[0] >= 50 and not got[5] and got[8] < got[0] / 2 and not got[6]
    assert quality_rules.judge(short + " and more.\nHome | News | Sport")[6]
    for text in (PROSE, PROSE + "\nSign in", short):
        j = quality_rules.judge(text)
        assert not j[6] or not brute(j[9])[5]


def brute_wrapped(lines, i):
    """The stated rule, line by line: same paragraph, no room for the next word, and an end mark reached through full lines."""
    end = lambda x: re.search(r"[.!?…。！？؟।][\"'”’»」』)\]*_]*(\s|$)", x) is not None
    if i + 1 >= len(lines) or not lines[i].split() or not lines[i + 1].split():
        return False
    lo, hi = i, i
    while lo > 0 and lines[lo - 1].split():
        lo -= 1
    while hi + 1 < len(lines) and lines[hi + 1].split():
        hi += 1
    width = max(len(x.rstrip()) for x in lines[lo:hi + 1])
    full = width >= 50 and len(lines[i].rstrip()) + 1 + len(lines[i + 1].split()[0]) > width
    return full and (end(lines[i + 1]) or brute_wrapped(lines, i + 1))


def test_wrapped_lines_equal_brute_force():
    import random
    draw = random.Random(5)
    for _ in range(300):
        lines = [" ".join(draw.choice(("Haus", "und", "die", "Straße.", "12", "\"ja\"", "gegangen", "x")) for _ in range(draw.choice((0, 1, 8, 9, 10, 11, 12)))) for _ in range(draw.randint(1, 8))]
        assert quality_rules.wrapped_lines(lines) == [brute_wrapped(lines, i) for i in range(len(lines))]
