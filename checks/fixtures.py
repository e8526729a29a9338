"""Reviews, token edges and predictions derived from the given tables.

Each fixture is one SELECT that runs unchanged in Spark SQL and in DuckDB.
"""

from __future__ import annotations


def pick(key: str, values: list[str]) -> str:
    """CASE over ``key % n`` choosing one of the values."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


K = "o_orderkey"
NOUN = pick(K, ["camera", "battery", "screen", "Speakers", "delivery", "thing", "app", "Product"])
NOUN2 = pick(f"({K} + 3)", ["battery", "price", "keyboard", "packaging", "online store"])
GOOD = pick(f"({K} + 5)", ["best", "amazing", "good", "flawless", "handy", "Great"])
BAD = pick(f"({K} + 1)", ["pathetic", "worthless", "trash", "disgusting", "bad", "noisy", "slow"])
TAIL = pick(f"({K} + 2)", ["drains quickly", "is fine", "is overheating", "feels cheap", "is a scam", "broke down", "is dim and loud"])
BUG = pick(f"({K} + 4)", ["bugs", "issues", "crashes", "problems", "glitches"])

REVIEW_TEXT = f"""CASE {K} % 16
WHEN 0 THEN CONCAT('The ', {NOUN}, ' is ', {GOOD}, ' but the ', {NOUN2}, ' ', {TAIL}, '.')
WHEN 1 THEN CONCAT('<b>', {GOOD}, '</b> ', {NOUN}, '! See https://shop.example.com/item?id=', {K}, ' for the ', {NOUN2}, '; it is ', {BAD}, '.')
WHEN 2 THEN CONCAT({NOUN}, ' arrived late. the ', {NOUN2}, ' is ', {GOOD}, '. However It stopped working and the screws fell apart.')
WHEN 3 THEN CONCAT('Total waste of money, yet the ', {NOUN}, ' design is good; ', {BAD}, ' waste of time')
WHEN 4 THEN CONCAT('It has many ', {BUG}, ' although ', {NOUN}, ' feels ', {GOOD}, ' and ', {BAD})
WHEN 5 THEN CONCAT('The ', {NOUN}, ' is good while the ', {NOUN}, ' is bad. The ', {NOUN}, ' is user-friendly, good and bad')
WHEN 6 THEN NULL
WHEN 7 THEN '   '
WHEN 8 THEN CONCAT('', {K})
WHEN 9 THEN 'the and of is'
WHEN 10 THEN CONCAT('I cannot recommend this ', {NOUN}, '? ', {BAD}, ' quality; hard to find ', {NOUN2})
WHEN 11 THEN CONCAT('Really ', {GOOD}, ' lovely. quickly ', {BAD}, '! ', {NOUN}, ' wanna return')
WHEN 12 THEN 'good! bad? good bad; best worst'
WHEN 13 THEN CONCAT('Sound and speakers are ', {GOOD}, ', the ', {NOUN}, ' is ', {BAD}, ' and draining fast')
WHEN 14 THEN CONCAT('This ', {NOUN}, ' came with a ', {NOUN2}, ' and a cable.')
ELSE REPEAT(CONCAT('The ', {NOUN}, ' is ', {GOOD}, '. A ', {BAD}, ' ', {NOUN2}, ' though; '), CAST(1 + {K} % 7 AS INT))
END"""

REVIEWS = f"SELECT CAST({K} AS BIGINT) AS review_id, {REVIEW_TEXT} AS text FROM orders"

# token: (text, lemma, pos, dep, head)
SENTENCES = [
    # great camera
    [("great", "great", "ADJ", "amod", 1), ("camera", "camera", "NOUN", "ROOT", 1)],
    # The battery is terrible and old
    [("The", "the", "DET", "det", 1), ("battery", "battery", "NOUN", "nsubj", 2), ("is", "be", "AUX", "ROOT", 2),
     ("terrible", "terrible", "ADJ", "acomp", 2), ("old", "old", "ADJ", "attr", 2)],
    # slow Battery drains quickly
    [("slow", "slow", "ADJ", "amod", 1), ("Battery", "battery", "NOUN", "nsubj", 2), ("drains", "drain", "VERB", "ROOT", 2),
     ("quickly", "quickly", "ADV", "advmod", 2)],
    # The screens were returned
    [("The", "the", "DET", "det", 1), ("screens", "screen", "NOUN", "nsubjpass", 3), ("were", "be", "AUX", "auxpass", 3),
     ("returned", "return", "VERB", "ROOT", 3)],
    # They sent the price
    [("They", "they", "PRON", "nsubj", 1), ("sent", "send", "VERB", "ROOT", 1), ("the", "the", "DET", "det", 3),
     ("price", "price", "NOUN", "dobj", 1)],
    # bad things (banned noun), ok TV (short noun)
    [("bad", "bad", "ADJ", "amod", 1), ("things", "thing", "NOUN", "ROOT", 1), ("good", "good", "ADJ", "amod", 3),
     ("TV", "tv", "PROPN", "conj", 1)],
    # good sound, noisy sound
    [("good", "good", "ADJ", "amod", 1), ("sound", "sound", "NOUN", "ROOT", 1), ("noisy", "noisy", "ADJ", "amod", 3),
     ("sound", "sound", "NOUN", "conj", 1)],
    # nothing to say
    [("came", "come", "VERB", "ROOT", 0), ("quickly", "quickly", "ADV", "advmod", 0)],
    # defective charger is such; odd cable
    [("defective", "defective", "ADJ", "amod", 1), ("charger", "charger", "NOUN", "nsubj", 2), ("is", "be", "AUX", "ROOT", 2),
     ("such", "such", "ADJ", "acomp", 2), ("odd", "odd", "ADJ", "amod", 5), ("Cable", "cable", "PROPN", "attr", 2)],
]

_EDGE_VALUES = ", ".join(
    f"({n}, {i}, '{text}', '{lemma}', '{pos}', '{dep}', {head})"
    for n, sentence in enumerate(SENTENCES)
    for i, (text, lemma, pos, dep, head) in enumerate(sentence)
)

EDGES = f"""SELECT CAST(o_orderkey AS BIGINT) AS review_id, CAST(v.i AS INT) AS i, v.text, v.lemma, v.pos, v.dep,
CAST(v.head_i AS INT) AS head_i
FROM orders JOIN (VALUES {_EDGE_VALUES}) AS v(n, i, text, lemma, pos, dep, head_i)
ON o_orderkey % {len(SENTENCES)} = v.n"""

PREDICTIONS = """SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label,
CAST(doc_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS p_positive FROM labels"""

CORPUS = """SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

# Every version holds the whole table; a later version states the text and language anew.
VERSIONS = """SELECT doc_id, text, lang, source, 1 AS version FROM documents
UNION ALL SELECT doc_id, CONCAT(text, ' good camera.') AS text, UPPER(lang) AS lang, source, 2 AS version FROM documents"""
