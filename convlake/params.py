"""Default parameter tables: small word lists and weights for the languages of the test tables. All are inputs."""

from __future__ import annotations

from .functions.rules import Rule

# Frequent function words of four languages.
LEXICON = {
    "en": "the of and to in that is for with on was as are by be this from at or an not have which you".split(),
    "fr": "le la les de des et un une en est pour que qui dans par sur au pas plus ne se ce".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "el la los las de que y en un una por con no para su al lo como más del se".split(),
}
PRIMARY, SECONDARY = LEXICON["fr"], LEXICON["en"]
OPENERS = ["why", "what", "how", "when", "where", "who", "pourquoi", "quand", "warum", "wie", "por", "cuando"]
SLANG = ["lol", "omg", "haha", "yep", "nope", "bro", "ok"]
SPEAKERS = {"user": "user", "human": "user", "customer": "user", "assistant": "persona", "bot": "persona", "agent": "persona", "system": "system"}

TONE = [
    Rule("humorous", "contains", ("haha", "lol", "rofl")),
    Rule("teasing", "contains", ("silly", "dummy", "loser", "clown")),
    Rule("uncertain", "contains", ("maybe", "perhaps", "peut", "vielleicht")),
    Rule("supportive", "contains", ("congrat", "bravo", "well done", "merci", "danke")),
    Rule("serious", "contains", ("emergency", "police", "hospital", "accident", "nicht")),
]
TONE_2 = [TONE[1], TONE[0], *TONE[2:]]
RESPONSE = [
    Rule("reaction", "equals", (".", "..", "...", "!", "?", "?!")),
    Rule("question", "contains", ("?",)),
    Rule("question", "starts", tuple(o + " " for o in OPENERS)),
    Rule("acknowledgement", "equals", ("ok", "okay", "yes", "yep", "done", "oui", "ja", "si")),
    Rule("refusal", "starts", ("no ", "nope", "non ", "nein ", "not ")),
    Rule("greeting", "starts", ("hi ", "hello", "hey ", "hallo", "bonjour", "hola")),
    Rule("invitation", "starts", ("come ", "let us ", "viens ", "komm ")),
    Rule("suggestion", "contains", (" try ", " should ", " could ", " peux ", " soll")),
]
RESPONSE_2 = [RESPONSE[0], RESPONSE[1], RESPONSE[2], RESPONSE[4], RESPONSE[6], RESPONSE[7], RESPONSE[3], RESPONSE[5]]
STATE = [
    Rule("closing", "contains", ("goodbye", "bye", "see you", "au revoir", "tschüss")),
    Rule("banter", "contains", ("haha", "lol", "clown", "loser")),
    Rule("agreement", "equals", ("ok", "okay", "yes", "sure", "oui", "ja", "si")),
    Rule("inquiry", "contains", ("?",)),
]
#: (order, topic, term, weight)
TOPICS = [
    (1, "places", "in", 1.0), (1, "places", "at", 0.8), (1, "places", "dans", 1.0), (1, "places", "im", 1.0),
    (2, "people", "you", 1.2), (2, "people", "qui", 1.0), (2, "people", "sich", 1.0), (2, "people", "su", 1.0),
    (3, "time", "was", 0.9), (3, "time", "when", 1.2), (3, "time", "als", 0.9), (3, "time", "cuando", 1.2),
    (4, "things", "this", 0.7), (4, "things", "that", 0.7), (4, "things", "une", 0.7), (4, "things", "das", 0.7),
]
#: (rank, topic, phrase, weight): phrases of one to four words; all are inputs.
PHRASES = [
    (1, "places", "in the", 1.0), (1, "places", "at the", 1.0), (1, "places", "in", 0.2), (1, "places", "dans le", 1.0), (1, "places", "auf der", 1.0),
    (2, "people", "with you", 1.5), (2, "people", "who is", 1.5), (2, "people", "you are", 1.2), (2, "people", "qui est", 1.2),
    (3, "time", "when it was", 2.0), (3, "time", "it was", 1.0), (3, "time", "this is not the", 2.0), (3, "time", "als das", 1.0),
    (4, "things", "that is", 1.0), (4, "things", "of the", 0.6), (4, "things", "is a", 0.6), (4, "things", "de la", 0.6), (4, "things", "das ist", 1.0),
]
DEPTHS = [1, 2, 4, 6]

_START, _END = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"  # of a word, in any alphabet and either engine
#: Words of what an utterance does, in the languages of the test tables. All are inputs.
ACTS = {
    "greets": "hi|hello|hey|hallo|bonjour|salut|hola",
    "thanks": "thanks|thank you|merci|danke|gracias",
    "leaves": "bye|goodbye|farewell|au revoir|adieu|tschüss|auf wiedersehen|adiós",
    "assents": "yes|yeah|ok|okay|sure|agreed|oui|d'accord|ja|gern|sí|vale",
    "dissents": "no|nope|never|non|jamais|nein|niemals|nunca",
    "asks": "who|what|when|where|why|which|how|qui|quoi|quand|pourquoi|comment|wer|was|wann|warum|wie|quién|qué|cuándo|dónde",
    "requests": "please|could you|can you|explain|show me|s'il vous plaît|expliquez|bitte|erkläre|por favor|explica",
    "dates": "today|tomorrow|tonight|next week|schedule|demain|ce soir|morgen|heute|mañana|hoy",
    "joins": "join|come along|let us|together|viens|venez|ensemble|komm|zusammen|ven|juntos",
    "jokes": "haha|hehe|lol|just kidding|mdr|jaja",
    "states": "is|are|was|were|has|est|sont|était|ist|sind|war|es|son|era",
    "suffers": "broken|failed|error|trouble|cassé|erreur|kaputt|fehler|roto|fallo",
}
#: Patterns that conditions name: {act} is a word of the act anywhere, {act_first} at the start, {act_only} all there is.
DECISION_WORDS = {
    name: pattern
    for act, words in ACTS.items()
    for name, pattern in ((act, f"{_START}({words}){_END}"), (f"{act}_first", f"^({words}){_END}"), (f"{act}_only", f"^({words})[.!?]*$"))
}
#: The order of the labels is fixed: bare words, replies to invitations and proposals, then acts from the most to the least specific.
#: Columns: low, clause, before, n_words.
INTENT_RULES = [
    ("unknown", "n_words = 0 OR RE(low, '{asks_only}')"),
    ("invitation", "RE(before, '{joins}') AND n_words <= 3 AND (RE(low, '{assents_first}') OR RE(low, '{dissents_first}'))"),
    ("agreement", "RE(before, '{dates}') AND n_words <= 3 AND RE(low, '{assents_first}')"),
    ("answer_request", "RE(low, '{requests}')"),
    ("planning", "RE(low, '{dates}')"),
    ("invitation", "RE(low, '{joins}') AND NOT RE(low, '{dissents}') AND NOT RE(clause, '{asks_first}')"),
    ("question", "RE(low, '[?]$') OR RE(clause, '{asks_first}')"),
    ("agreement", "RE(low, '{assents_first}')"),
    ("disagreement", "RE(low, '{dissents_first}')"),
    ("information", "n_words >= 5 AND RE(low, '{states}')"),
    ("reaction", "RE(low, '!$') OR RE(low, '{jokes}')"),
    ("casual_chat", "RE(low, '{greets}') OR RE(low, '{thanks}') OR RE(low, '{leaves}')"),
    ("information", "n_words >= 8"),
]
#: Columns: low, intent, state, ambiguity, topic. A conversation that closes comes first (fixed).
STRATEGY_RULES = [
    ("close_conversation", "state = 'closing'"),
    ("decline", "intent = 'invitation' AND RE(low, '{dissents}')"),
    ("accept", "intent = 'invitation'"),
    ("ask_clarification", "ambiguity = 'high' AND intent IN ('unknown', 'question', 'answer_request')"),
    ("provide_information", "intent = 'answer_request' AND topic NOT IN ('casual_chat', 'other')"),
    ("answer", "intent IN ('question', 'answer_request') OR state = 'inquiry'"),
    ("suggest", "intent = 'planning' OR RE(low, '{suffers}')"),
    ("continue_banter", "state = 'banter'"),
    ("acknowledge", "intent IN ('agreement', 'information') OR state = 'agreement'"),
]
#: Columns: low, intent, state, topic: first the state, then the topic, then the text (fixed).
TONE_RULES = [
    ("teasing", "state = 'banter' AND intent = 'disagreement'"),
    ("humorous", "state = 'banter'"),
    ("neutral", "topic NOT IN ('casual_chat', 'other', 'people') AND intent IN ('question', 'answer_request')"),
    ("supportive", "RE(low, '{suffers}')"),
    ("serious", "intent = 'disagreement'"),
]
#: What a reply of each strategy is to reach, and whether memories may serve it.
AIMS = {
    "accept": ("take part", True),
    "decline": ("stay out", True),
    "answer": ("settle what was asked", True),
    "acknowledge": ("show that it was heard", True),
    "ask_clarification": ("find out what is meant", False),
    "suggest": ("name a next step", True),
    "react": ("share the feeling", True),
    "continue_banter": ("keep the game going", True),
    "provide_information": ("pass on facts", True),
    "close_conversation": ("part", False),
}
AIM = "follow the profile"
#: What is said of memories: some are given, none are, they have no say.
MEMORY_NOTES = ("given", "none", "off")
