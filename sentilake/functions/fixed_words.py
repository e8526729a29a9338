"""Word lists and weights that decide the results.

Every list below is data, not code. It is stated in its natural order and may
be replaced per job through :class:`sentilake.functions.lexicon.Lexicon` or
:class:`sentilake.config.CleanConfig`.
"""

# --- fixed values: English stop words (alphabetic entries of the public NLTK list) ---
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y
ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split())

# --- fixed values: words the public treebank tokenizer cuts in two ---
FUSED_WORDS = (
    ("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"),
)

# --- fixed values: nouns whose dictionary form is not reached by the plural rule ---
IRREGULAR_NOUNS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "knives": "knife", "wives": "wife", "lives": "life",
    "leaves": "leaf", "shelves": "shelf", "halves": "half", "movies": "movie", "cookies": "cookie",
    "shoes": "shoe", "toes": "toe", "canoes": "canoe", "oboes": "oboe", "foes": "foe",
    "diagnoses": "diagnosis", "analyses": "analysis", "crises": "crisis",
}
# Words that end like a plural and are none.
KEPT_NOUNS = (
    "series", "species", "lens", "news", "always", "sometimes", "perhaps", "besides", "towards", "whereas", "alas", "gas", "bias",
    "atlas", "alias", "canvas", "texas", "kansas", "arkansas", "dallas", "vegas", "christmas", "pajamas", "physics", "mathematics",
    "politics", "economics", "electronics", "ergonomics", "aerobics", "athletics", "gymnastics", "logistics", "ethics",
    "genetics", "acoustics", "optics", "linguistics", "robotics", "aesthetics", "dynamics", "mechanics",
)
# Nouns on -s that take -es; those on -ss, -ch, -sh, -x and -o need no list.
NOUNS_WITH_ES = (
    "gas", "bias", "atlas", "alias", "canvas", "lens", "bus", "virus", "bonus", "focus", "campus", "status", "chorus", "genius",
    "minus", "plus", "census", "circus", "surplus", "sinus", "octopus", "iris",
)

# --- fixed values: connectives and candidate label names ---
CLAUSE_CONNECTIVES = ("but", "however", "though", "although", "whereas", "while", "yet")
POSITIVE_LABEL_NAMES = ("positive", "pos", "1")
NEGATIVE_LABEL_NAMES = ("negative", "neg", "0")

# --- fixed values: sentiment lexicon ---
POSITIVE_CUES = tuple("""
good great excellent amazing awesome best love smooth reliable clear perfect impressed thrilled appreciate
quick fast wonderful fantastic superb outstanding brilliant exceptional magnificent marvelous terrific
splendid delightful pleasant enjoyable satisfying remarkable impressive flawless elegant beautiful gorgeous
stunning comfortable convenient intuitive responsive durable sturdy solid lightweight portable versatile
efficient powerful crisp sharp vibrant bright premium luxurious affordable worth bargain recommend
recommended favorite favourite pleased happy glad satisfied exceeded surpassed upgrade improved innovative
seamless effortless user-friendly friendly helpful polite courteous professional prompt speedy swift instant
accurate precise consistent dependable trustworthy generous spacious roomy quiet silent sleek stylish modern
compact handy practical functional robust stable secure safe refreshing exciting fun entertaining engaging
addictive phenomenal incredible unbelievable extraordinary top-notch first-rate world-class superior ideal
spotless immaculate pristine genuine authentic
""".split())

NEGATIVE_CUES = tuple("""
bad worst poor terrible lag drain draining overheat overheating issue problem broken late delay slow bugs bug
hard awful horrible dreadful atrocious abysmal pathetic mediocre subpar inferior disappointing disappointed
frustrating frustrated annoying annoyed irritating useless worthless waste garbage trash junk cheap flimsy
fragile defective faulty malfunctioning malfunction unreliable inconsistent unstable crash crashes crashing
freeze freezes freezing glitch glitchy laggy sluggish unresponsive clunky bulky heavy noisy loud uncomfortable
painful confusing complicated difficult cumbersome awkward ugly hideous outdated obsolete overpriced expensive
ripoff scam misleading deceptive fake counterfeit damaged scratched dented stained leaked leaking leak
cracked chipped peeling rusted corroded stink stinks smell smelly disgusting gross nasty rude unprofessional
incompetent unhelpful ignored neglected refund return returned regret hate hated dislike avoid warning beware
underwhelming lackluster bland boring dull lifeless weak dim blurry pixelated distorted tinny muffled
""".split())

POSITIVE_WEIGHTS = {
    "good": 1.2, "great": 1.4, "excellent": 1.6, "amazing": 1.6, "awesome": 1.5, "best": 1.3, "love": 1.3,
    "smooth": 1.0, "reliable": 1.0, "clear": 0.8, "perfect": 1.4, "impressed": 1.2, "thrilled": 1.3,
    "appreciate": 1.0, "quick": 0.9, "fast": 0.6, "wonderful": 1.5, "fantastic": 1.5, "superb": 1.6,
    "outstanding": 1.6, "brilliant": 1.5, "exceptional": 1.6, "magnificent": 1.6, "marvelous": 1.5,
    "terrific": 1.4, "splendid": 1.4, "delightful": 1.3, "pleasant": 1.0, "enjoyable": 1.1, "satisfying": 1.1,
    "remarkable": 1.3, "impressive": 1.3, "flawless": 1.7, "elegant": 1.2, "beautiful": 1.3, "gorgeous": 1.4,
    "stunning": 1.4, "comfortable": 1.1, "convenient": 1.0, "intuitive": 1.2, "responsive": 1.1,
    "durable": 1.1, "sturdy": 1.1, "solid": 1.0, "lightweight": 0.8, "portable": 0.8, "versatile": 1.0,
    "efficient": 1.1, "powerful": 1.2, "crisp": 1.0, "sharp": 1.0, "vibrant": 1.1, "bright": 0.8,
    "premium": 1.2, "luxurious": 1.3, "affordable": 1.1, "worth": 1.0, "bargain": 1.1, "recommend": 1.3,
    "recommended": 1.3, "favorite": 1.2, "favourite": 1.2, "pleased": 1.2, "happy": 1.2, "satisfied": 1.1,
    "exceeded": 1.4, "surpassed": 1.4, "innovative": 1.2, "seamless": 1.3, "effortless": 1.2,
    "phenomenal": 1.7, "incredible": 1.6, "extraordinary": 1.6, "superior": 1.4, "ideal": 1.2, "robust": 1.1,
    "stable": 1.0, "secure": 1.0, "exciting": 1.2, "fun": 1.0, "engaging": 1.1,
}

NEGATIVE_WEIGHTS = {
    "bad": 1.2, "worst": 1.6, "poor": 1.2, "terrible": 1.6, "lag": 1.4, "drain": 1.8, "draining": 1.8,
    "overheat": 1.8, "overheating": 1.8, "issue": 1.5, "problem": 1.5, "broken": 1.8, "late": 1.2,
    "delay": 1.2, "slow": 1.0, "bugs": 1.8, "bug": 1.8, "hard": 1.0, "awful": 1.6, "horrible": 1.6,
    "dreadful": 1.6, "atrocious": 1.8, "abysmal": 1.8, "pathetic": 1.6, "mediocre": 1.0, "subpar": 1.2,
    "inferior": 1.3, "disappointing": 1.5, "disappointed": 1.5, "frustrating": 1.5, "frustrated": 1.5,
    "annoying": 1.4, "useless": 1.7, "worthless": 1.8, "waste": 1.5, "garbage": 1.8, "trash": 1.8,
    "junk": 1.7, "cheap": 1.2, "flimsy": 1.4, "fragile": 1.2, "defective": 1.8, "faulty": 1.7,
    "malfunctioning": 1.8, "unreliable": 1.5, "unstable": 1.4, "crash": 1.7, "crashes": 1.7, "crashing": 1.7,
    "freeze": 1.5, "freezes": 1.5, "glitch": 1.5, "glitchy": 1.5, "laggy": 1.5, "sluggish": 1.3,
    "unresponsive": 1.6, "clunky": 1.3, "uncomfortable": 1.3, "confusing": 1.2, "complicated": 1.1,
    "overpriced": 1.5, "expensive": 1.2, "ripoff": 1.8, "scam": 1.8, "misleading": 1.5, "deceptive": 1.6,
    "damaged": 1.6, "leaked": 1.5, "leaking": 1.5, "cracked": 1.5, "disgusting": 1.7, "gross": 1.5,
    "nasty": 1.5, "rude": 1.5, "unprofessional": 1.5, "incompetent": 1.6, "regret": 1.4, "hate": 1.6,
    "hated": 1.6, "avoid": 1.5, "underwhelming": 1.3, "lackluster": 1.3, "boring": 1.2, "weak": 1.2,
    "blurry": 1.4, "distorted": 1.4,
}

FORCED_NEGATIVE_ANY = (
    "drain", "draining", "defective", "malfunctioning", "malfunction", "scam", "ripoff", "counterfeit", "fake",
)

FORCED_NEGATIVE_GROUPS = (
    ("hard", "find"), ("waste", "money"), ("waste", "time"), ("not", "worth"), ("does", "not", "work"),
    ("stopped", "working"), ("fell", "apart"), ("broke", "down"),
)

FORCED_NEGATIVE_SCORE = 0.82
FORCED_GROUP_NEGATIVE_SCORE = 0.72
CUE_SCORE = 0.7
NEUTRAL_CONFIDENCE_THRESHOLD = 0.6

BANNED_ASPECT_TOKENS = tuple("""
went online information impressed thrilled appreciate appreciated effort made send chose choice choices wear
find taken without especially really hard lot many much very has have had keep keeps good great bad excellent
amazing awesome poor worst best fast slow quick late early draining drain buggy thing things something
anything everything nothing way time day year got get getting would could also even still just like one two
first last new old use used using bought buy buying tried try
""".split())

PREFERRED_FEATURES = tuple("""
camera battery product platform bug bugs delivery size quality price selection pant pants store service
support performance design screen display speaker speakers sound audio microphone keyboard mouse trackpad
touchscreen charger charging cable port wifi bluetooth storage memory processor speed weight build material
packaging shipping warranty software app interface setup installation durability comfort fit color brightness
resolution volume connectivity range accuracy sensitivity responsiveness value
""".split())

BUG_FEATURES = (
    "bug", "bugs", "issue", "issues", "problem", "problems", "glitch", "glitches", "error", "errors",
    "crash", "crashes", "defect", "defects", "flaw", "flaws",
)

# --- fixed values: the lexicon used when a named lexicon file cannot be read ---
FALLBACK_POSITIVE_CUES = ("good", "great", "excellent", "love")
FALLBACK_NEGATIVE_CUES = ("bad", "worst", "poor", "terrible")
