"""Word lists and constants of the pattern engine."""

# Results depend on each of them.
TRANSITIONS = ["however", "furthermore", "moreover", "therefore", "meanwhile", "consequently", "additionally", "ultimately", "in fact", "in contrast", "for instance", "for example"]
FILLER = ["very", "really", "just", "quite", "basically", "simply", "clearly", "obviously", "remarkably", "significantly", "incredibly", "essentially", "actually", "literally", "deeply", "profoundly", "truly", "particularly", "especially"]
STRUCTURE = ["on the one hand", "on the other hand", "the key takeaway", "in other words", "the truth is", "the reality is", "what this means", "to put it simply", "one of the most", "it is worth noting"]
FICTION_TELL = ["felt a wave of", "felt a sense of", "a sense of", "he knew that", "she knew that", "it was clear that", "the reader can see", "you can imagine", "emotionally", "overwhelmingly", "deeply", "profoundly"]
REGISTER = ["documentary", "explore", "navigate", "delve into", "journey through", "the landscape of", "in the age of", "the world of", "a powerful reminder", "a testament to", "underscore the importance", "showcase", "foster", "leverage"]
MODIFIERS = ["very", "really", "just", "quite", "rather", "fairly", "deeply", "simply", "clearly", "obviously", "truly", "particularly", "especially", "remarkably", "incredibly"]
CONCRETE = ["stone", "door", "window", "table", "road", "river", "chair", "hand", "bread", "bridge", "paper", "kettle", "light", "wall", "coat", "floor", "market", "street", "room"]
ABSTRACT = ["truth", "meaning", "purpose", "freedom", "emotion", "feeling", "system", "process", "context", "journey", "landscape", "universe", "experience"]
#: What the detector of derived hits takes for concrete and abstract.
DERIVED_CONCRETE = ["stone", "door", "window", "table", "road", "river", "chair", "hand", "bread", "bridge", "paper", "kettle", "light", "wall", "coat", "floor", "market", "street", "room", "shelf", "rain", "book", "ledger"]
DERIVED_ABSTRACT = ["truth", "meaning", "purpose", "emotion", "feeling", "system", "process", "context", "journey", "landscape", "future", "importance", "need", "impact", "challenge", "opportunity"]
DOCUMENT_MODES = ["fiction", "essay", "marketing", "business", "worldbuilding"]
#: Weight of the target and of the batch, by mode; any other mode.
TARGET_WEIGHTS = {"preserve": (0.25, 0.75), "house": (0.8, 0.2), "hybrid": (0.55, 0.45), "frozen": (0.7, 0.3)}
OTHER_WEIGHTS = (0.5, 0.5)
MODE_INTENSITY = {"preserve": 0.9, "house": 1.12, "hybrid": 1.0, "frozen": 0.96}
BUDGET_INTENSITY = {"minimal": 0.72, "medium": 1.0, "aggressive": 1.42}
#: Factor of each figure of a profile before it is cut to 0..1.
PROFILE_SCALE = {
    "avg_sentence": 1 / 30, "sentence_spread": 1 / 18, "avg_paragraph": 1 / 180, "lexical_diversity": 1.0, "contraction_rate": 10.0, "dialogue_density": 1 / 4, "em_dash_rate": 2.5, "semicolon_rate": 3.5,
    "question_rate": 3.5, "exclamation_rate": 4.0, "fragment_rate": 1.0, "long_sentence_rate": 1.0, "modifier_density": 10.0, "concrete_density": 12.0, "abstract_density": 12.0,
}
# What the document modes are called, stand for and guard.
MODE_POLICIES = {
    "fiction": ("Fiction", "Fiction-safe", "Protect scene texture, dialogue rhythm, and chapter-style headings. Avoid essay-like cleanup that flattens narration.", ["Keep narration texture", "Do not force tidy conclusions", "Leave heading style alone"]),
    "essay": ("Essay", "Essay mode", "Push hard on abstraction, filler, and generic wrap-up language while keeping an authorial argument intact.", ["Trim hedging", "Prefer direct claims", "Keep intentional structure"]),
    "marketing": ("Marketing", "Marketing mode", "Keep persuasive energy and product voice, but trim brochure sludge, filler, and chatbot framing.", ["Preserve persuasive tone", "Cut brochure sludge", "Keep calls to action clear"]),
    "business": ("Business", "Business mode", "Favour direct statements, concrete claims, and clean structure without forcing fiction-style vividness.", ["Prefer concrete claims", "Keep neutral clarity", "Avoid unnecessary flourish"]),
    "worldbuilding": ("Worldbuilding", "Worldbuilding-safe", "Protect lore texture and elevated register, but still remove synthetic exposition and assistant residue.", ["Protect lore diction", "Keep chapter and codex texture", "Trim synthetic exposition"]),
}
#: Guardrails that are shown.
SHOWN_GUARDRAILS = 2
