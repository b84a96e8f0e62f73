"""Word lists and patterns of the core engine."""

# Abbreviations that end in a full stop without ending a sentence.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "ft", "mt", "gen", "gov", "sgt", "cpl", "pvt", "capt", "lt", "col", "maj", "rev",
    "hon", "pres", "dept", "univ", "assn", "bros", "inc", "ltd", "co", "corp", "vs", "al", "approx", "est", "vol", "fig", "eq", "no",
]
ABBREVIATION_PAIRS = ["e.g", "i.e", "a.m", "p.m", "u.s", "u.k", "u.n"]

# Filler phrases, what may follow them, and what takes their place.
FILLERS = [
    (["it is important to note that", "it's important to note that"], "", ""),
    (["it should be noted that"], "", ""),
    (["in many ways"], "[, ]*", ""),
    (["in some ways"], "[, ]*", ""),
    (["at the end of the day"], "[, ]*", ""),
    (["ultimately"], "[, ]*", ""),
    (["moreover"], "[, ]*", ""),
    (["furthermore"], "[, ]*", ""),
    (["additionally"], "[, ]*", ""),
    (["in order to"], "", "to"),
    (["due to the fact that"], "", "because"),
    (["the fact that"], "", ""),
]

# Word lists of the signals.
TRANSITIONS = ["however", "moreover", "furthermore", "additionally", "ultimately", "notably", "meanwhile"]
INTENSIFIERS = ["very", "really", "quite", "rather", "somewhat", "truly", "clearly", "literally", "actually", "basically", "fairly", "simply"]
NOT_MODIFIERS = [
    "family", "only", "early", "elderly", "friendly", "lonely", "daily", "weekly", "monthly", "yearly", "holy", "ugly", "likely", "unlikely",
    "rally", "tally", "belly", "bully", "folly", "jolly", "ally", "assembly", "supply", "apply", "reply", "imply", "multiply", "fly", "july",
    "italy", "butterfly", "jelly", "billy", "lily", "sally", "molly", "emily", "kelly", "polly", "holly", "wily",
]
GENERIC_WORDS = [
    "thing", "things", "stuff", "aspect", "aspects", "situation", "scenarios", "important", "interesting", "impactful", "various", "several", "many", "meaningful",
]
CLICHES = [
    "at the end of the day", "calm before the storm", "tip of the iceberg", "needless to say", "in the blink of an eye", "the kind of", "a sense of", "you could feel", "it was as if",
]
ABSTRACT_WORDS = [
    "journey", "fabric", "tapestry", "essence", "landscape", "dynamic", "framework", "process", "narrative", "perspective", "system", "approach", "context",
]

# Expanded and contracted forms, in the order in which they are applied.
CONTRACTIONS = [
    ("do not", "don't"), ("does not", "doesn't"), ("did not", "didn't"), ("cannot", "can't"), ("could not", "couldn't"), ("would not", "wouldn't"),
    ("should not", "shouldn't"), ("will not", "won't"), ("is not", "isn't"), ("are not", "aren't"), ("was not", "wasn't"), ("were not", "weren't"),
    ("have not", "haven't"), ("has not", "hasn't"), ("had not", "hadn't"), ("it is", "it's"), ("that is", "that's"), ("there is", "there's"),
    ("I am", "I'm"), ("I have", "I've"), ("I will", "I'll"), ("we are", "we're"), ("they are", "they're"),
]

# The passive construction, case aside.
PASSIVE = (
    r"\b(?:was|were|been|being|is|are|am|get|got|gets|getting)\s+(?:(?:not|never|always|often|already|also|then|soon|finally|fully|quickly|slowly|immediately|subsequently|reportedly|recently)\s+)*"
    r"(?:\w+ed|written|made|done|seen|taken|given|found|told|known|shown|broken|chosen|driven|eaten|fallen|forgotten|frozen|hidden|mistaken|proven|ridden|risen|shaken|spoken|stolen|sworn|torn|worn|woven)\b"
)

# Adjectives before which an intensifier goes.
SLOPPY_ADJECTIVES = [
    "meaningful", "impactful", "important", "interesting", "significant", "remarkable", "powerful", "incredible", "amazing", "stunning", "compelling", "profound", "unique",
]

# The dimensions of a voice profile with their weights in a distance.
VOICE_WEIGHTS = {
    "avg_sentence_length": 0.14,
    "sentence_length_std": 0.1,
    "avg_paragraph_sentences": 0.08,
    "dialogue_ratio": 0.08,
    "contraction_rate": 0.1,
    "comma_rate": 0.08,
    "question_rate": 0.04,
    "exclamation_rate": 0.03,
    "emdash_rate": 0.07,
    "semicolon_rate": 0.04,
    "lexical_diversity": 0.1,
    "long_sentence_rate": 0.07,
    "fragment_rate": 0.04,
    "modifier_rate": 0.03,
}
