"""Words and patterns of the text rules.

Fixed values: they must equal the published rules for equal results. Order matters where a rule says "first".
"""

FILLERS = [
    "umm", "uh", "uhh", "hmm", "you know", "actually", "basically", "i mean", "like", "so", "well", "right",
    "matlab", "yani", "aur", "toh", "na", "haan",
    "मतलब", "यानी", "तो", "ना", "हाँ", "अच्छा",
    "म्हणजे", "बरं", "हो ना",
]

SPELLINGS = {
    "gaanv": "gaon", "gaaon": "gaon", "gaon": "gaon", "gawn": "gaon", "gram": "gaon",
    "sadak": "road", "rasta": "road", "raasta": "road", "raste": "road",
    "paani": "water", "pani": "water", "paanee": "water",
    "aspatal": "hospital", "aspataal": "hospital", "dawakhana": "hospital",
    "vidyalaya": "school", "shala": "school", "shaala": "school",
}

OTHER_SCRIPTS = [
    ("bn-Beng", "ঀ-৿"), ("pa-Guru", "਀-੿"), ("gu-Gujr", "઀-૿"),
    ("or-Orya", "଀-୿"), ("ta-Taml", "஀-௿"), ("te-Telu", "ఀ-౿"),
    ("kn-Knda", "ಀ-೿"), ("ml-Mlym", "ഀ-ൿ"),
]
DEVANAGARI = "ऀ-ॿ"

SUPPORTED = ("hi-Deva", "mr-Deva", "hi-Latn", "mixed", "en")
LANGUAGE_CONFIDENCE = {"hi-Deva": 0.95, "mr-Deva": 0.95, "en": 0.90, "hi-Latn": 0.80, "mixed": 0.70}

# "आमच्या" counts three times, as in the published list.
MARATHI = [
    "आहे", "नाही", "मला", "तुम्ही", "काय", "गाव", "आमच्या", "आमच्या", "त्यांनी", "होते", "केले", "आम्हाला", "आमच्या",
    "झाले", "असे", "तसे", "जवळ", "च्या", "ला", "ना", "हो",
]
HINDI = [
    "है", "हैं", "था", "थे", "की", "के", "का", "में", "से", "को", "पर", "और", "भी", "नहीं", "हमारे", "हमारा", "यहाँ",
    "वहाँ", "बहुत",
]
HINDI_LATIN = [
    "hai", "nahi", "gaon", "sadak", "paani", "pani", "bahut", "kharab", "baarish", "rasta", "ganda", "nala", "bijli",
    "sarkaar", "doctor", "aspatal", "theek", "achha", "zyada", "bilkul",
]

CATEGORY_WORDS = {
    "road": [
        "सड़क", "सड़के", "रास्ता", "रस्ता", "रोड", "गड्ढा", "गड्ढे", "गड्ढों", "टूटी", "टूटा", "टूटे", "खराब सड़क",
        "कच्ची सड़क", "टूटी सड़क", "दुर्घटना",
        "road", "sadak", "rasta", "pothole", "gaddha", "gaddhe", "gaddho", "broken road", "kacchi sadak",
        "highway", "bridge", "culvert", "path", "track", "pavement", "unpaved", "damaged road", "bad road", "accident",
        "रस्ता", "रस्त्याची", "खड्डा", "खड्डे", "रस्त्यात",
    ],
    "water": [
        "पानी", "नल", "बोरवेल", "पेयजल", "पानी की समस्या", "पानी नहीं", "गंदा पानी", "नल खराब",
        "water", "paani", "pani", "nala", "borewell", "naala", "drinking water", "ganda pani",
        "tap", "pipeline", "supply", "shortage", "contaminated", "leakage", "drainage", "sewage",
        "पाणी", "पाण्याची", "नळ", "बोअरवेल", "पाणीपुरवठा", "दूषित पाणी",
    ],
    "health": [
        "अस्पताल", "दवाखाना", "डॉक्टर", "दवा", "स्वास्थ्य", "स्वास्थ्य केंद्र", "एम्बुलेंस", "नर्स",
        "hospital", "doctor", "dawakhana", "aspatal", "phc", "medicine", "ambulance", "health centre", "clinic",
        "medical", "nurse", "health", "dispensary", "asha", "vaccination", "immunization",
        "रुग्णालय", "दवाखाना", "डॉक्टर", "औषध", "आरोग्य", "आरोग्य केंद्र",
    ],
    "education": [
        "स्कूल", "विद्यालय", "पाठशाला", "शिक्षक", "अध्यापक", "कक्षा", "पढ़ाई", "किताब",
        "school", "vidyalaya", "teacher", "padhna", "kitab", "student", "class",
        "education", "classroom", "textbook", "midday meal", "anganwadi", "enrolment",
        "शाळा", "शिक्षक", "वर्ग", "विद्यार्थी", "पुस्तके", "शाळेत",
    ],
}

SEVERITY_HIGH = [
    "बहुत", "बेहद", "गंभीर", "खतरनाक", "बार-बार", "हमेशा", "तुरंत", "आपातकाल",
    "bahut", "severe", "urgent", "critical", "emergency", "repeated", "bar bar", "baar baar", "always", "every day",
    "har din", "dangerous", "crisis", "accident", "deaths", "injuries", "collapsed",
    "खूप", "गंभीर", "धोकादायक", "वारंवार", "नेहमी",
]
SEVERITY_LOW = [
    "thoda", "थोड़ा", "kabhi kabhi", "कभी-कभी", "minor", "slight", "sometimes", "occasional", "थोडे", "कधी कधी",
]

TRIGGERS = [
    "village", "gaon", "gram", "ward", "block", "near", "in", "at", "of", "from", "mein", "district", "tehsil",
    "taluka", "panchayat", "paas", "pas", "javal", "jawal", "chowk", "phata", "naka",
    "गांव", "गाव", "गाँव", "ग्राम", "वार्ड", "ब्लॉक", "जवळ", "पास", "में", "मे", "के", "की", "जिला", "तहसील",
    "पंचायत", "तालुका",
]
DEVANAGARI_STOPWORDS = [
    "है", "हैं", "था", "थे", "की", "के", "का", "में", "से", "को", "पर", "और", "भी", "नहीं", "यह", "वह", "हम", "आप",
    "यहाँ", "वहाँ", "बहुत", "गंभीर", "खराब", "पानी", "सड़क", "अस्पताल", "स्कूल", "बोरवेल", "नल", "आहे", "नाही", "मला",
    "गाव", "पाणी", "रस्ता",
]
PHRASE_NOISE = [
    "mein", "me", "near", "in", "at", "of", "from", "the", "village", "gaon", "gram", "ward", "block", "district",
    "tehsil", "taluka", "panchayat", "ke", "ki", "ka",
]
DOMAIN_NOISE = [
    "road", "sadak", "rasta", "rastha", "gaddha", "pothole", "highway", "water", "paani", "pani", "nal", "borewell",
    "tap", "supply", "pipe", "hospital", "aspatal", "dawakhana", "doctor", "clinic", "phc", "health", "school", "shala",
    "shikshak", "teacher", "class", "education",
    "bahut", "kharab", "bura", "buri", "haalat", "samasya", "problem", "nahi", "nahin", "hai", "hain", "he", "se", "kal",
    "din", "teen", "hamare", "hamara", "humara", "our", "is", "very", "bad", "please", "fix", "issue", "urgent",
    "turant", "severe", "cut", "off", "been", "has", "and", "for", "two", "days", "now", "no", "available", "center",
]

BRIDGE = [
    "bridge", "culvert", "flyover", "overbridge", "footbridge", "pul", "pool", "setu", "पूल", "सेतु", "साकव",
]
BUILDING = [
    "building", "roof", "wall", "ceiling", "classroom", "school", "hospital", "phc", "clinic", "dispensary",
    "subcentre", "sub-centre", "structure", "chhat", "deewar", "diwar", "imarat", "bhint", "kholi", "kamra",
    "छत", "दीवार", "भिंत", "इमारत", "खोली", "कमरा", "शाळा", "रुग्णालय", "दवाखाना", "वर्ग", "कक्षा", "टाकी", "tank",
]
COLLAPSE = [
    "collapse", "collapsed", "collapsing", "washed away", "washed out", "fallen down", "fell down", "caved in",
    "cave in", "destroyed", "गिर गया", "गिर गई", "ढह गया", "ढह गई", "बह गया", "बह गई", "ध्वस्त",
    "gir gaya", "gir gayi", "dhah gaya", "dhah gayi", "beh gaya", "beh gayi",
    "कोसळला", "कोसळली", "वाहून गेला", "वाहून गेली", "पडला", "पडली", "उद्ध्वस्त", "खचून गेला",
    "kosalla", "kosalli", "vahun gela", "vahun geli", "padla", "padli",
]
PARTIAL = [
    "partially collapsed", "partial collapse", "partially damaged", "partial damage", "damaged", "broken", "fractured",
    "weakened", "sinking", "tilted", "unsafe", "gave way",
    "क्षतिग्रस्त", "टूटा हुआ", "टूटी हुई", "टूट गया", "टूट गई", "नुकसान",
    "tuta", "tuti", "tut gaya", "tut gayi", "kshatigrast",
    "पडझड", "मोडतोड", "खचला", "खचली", "मोडला", "मोडली", "भंगला", "padjhad", "khachla", "khachli", "modla", "modli",
]
CRACK = [
    "crack", "cracks", "cracked", "hairline", "fissure", "crevice", "दरार", "दरारें", "तरेड़", "चटक", "darar", "dararein",
    "तडा", "तडे", "भेग", "भेगा", "चिर", "चिरा", "tada", "tade", "bheg", "bhega",
]

# Photo damage: patterns matched without regard to case.
PHOTO_STRUCTURE = {
    "bridge": r"bridge|culvert|causeway|\bpul\b|\bpool\b|\bpuliya\b|\bsakav\b|पूल|पुल|पुलिया|साकव|मोरी",
    "building": r"building|wall|roof|ceiling|classroom|\bimarat\b|\bbhint\b|\bdeewar\b|\bdiwar\b|\bchhat\b|"
                r"इमारत|भिंत|दीवार|दिवार|छत|छप्पर|वर्ग ?खोली",
}
PHOTO_GRADE = {
    "collapse": r"collaps|caved in|fell down|washed away|gir gaya|gir gayi|dhah gay|toot gaya|tut gaya|bah gaya|koslal|"
                r"कोसळ|ढह|गिर गय|टूट गय|बह गय|वाहून गेल|पडल[ाे]",
    "partial": r"damag|broken|partly|partial|sinking|subsid|dhasal|khachal|tootla|tutla|"
               r"क्षतिग्रस्त|नुकसान|तुटल|खचल|धसल|टूटा|टूटी|धंस",
    "crack": r"crack|\bdarar\b|\btada\b|\btade\b|\bbheg\b|दरार|तडा|तडे|भेग",
}
EDITING_SOFTWARE = (
    r"photoshop|lightroom|gimp|snapseed|picsart|facetune|canva|pixlr|affinity|meitu|photoscape|paint\.net|screenshot|"
    r"screen ?capture"
)
FLAG_WEIGHTS = {
    "reused_photo": 0.45, "static_burst": 0.35, "screen_replay_suspected": 0.35, "captured_far_from_village": 0.30,
    "possibly_edited": 0.0, "editing_software": 0.25, "not_live_capture": 0.20, "capture_time_mismatch": 0.10,
    "no_capture_gps": 0.05,
}
REVIEW_FLAGS = [
    "reused_photo", "static_burst", "screen_replay_suspected", "captured_far_from_village", "editing_software",
]

PHONE = r"\b[6-9]\d{9}\b"
TITLED_NAME = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Shri|Smt)\.?\s+[A-Z][a-zA-Z]*\b"
# Someone naming themselves: possessive, the word for name, a verb.
SELF_POSSESSIVE = "mera|meraa|maza|majha|mazha|my"
SELF_POSSESSIVE_DEVANAGARI = ("मेरा", "मेरे", "माझं", "माझे", "माझ्या")
SELF_NOUN = "naam|naav|nam|name"
SELF_NOUN_DEVANAGARI = "नाम|नाव"
SELF_VERB = "is|hai|aahe|ahe"
SELF_VERB_DEVANAGARI = ("है", "आहे")
NOT_A_NAME = "आहे|आहेत|है|हैं"
MOBILE = r"^[6-9]\d{9}$"
PINCODE = r"^\d{6}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
GENDERS = ("male", "female", "transgender")

DEPARTMENTS = {
    "pwd": "road", "zp-works": "road", "zp-water": "water", "mjp": "water", "zp-health": "health", "dho": "health",
    "zp-education": "education", "deo": "education",
}

ROAD_REFERENCE = r"(?i)^(NH|SH|MDR|ODR|VR|RR)[\s\-–]*\d*|^\d+(\.\d+)?$"
ROAD_PREFIX = r"^(NH|SH|MDR|ODR|VR)[\s\-–]*\d*[A-Za-z]?"
