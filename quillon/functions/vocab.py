"""Word lists, lookup tables and patterns whose content decides results.

Every function that uses one takes it as a parameter with these as defaults.
"""

# One suffix at most is dropped, the longest that fits, and three characters stay.
SUFFIXES = [
    "lardan", "lerden", "larda", "lerde", "ndan", "nden", "ndaki", "ndeki",
    "lar", "ler", "dan", "den", "tan", "ten", "nin", "nın", "nun", "nün",
    "in", "ın", "un", "ün", "de", "da", "te", "ta", "ye", "ya", "yi", "yı",
    "yu", "yü", "si", "sı", "su", "sü", "i", "ı", "u", "ü", "e", "a", "s",
]

# What separates tokens.
SEPARATORS = "[^0-9a-zçğıöşü]+"

# Words without weight in a query.
STOP_WORDS = ["ve", "ile", "için", "bir", "the"]
TYPE_STOP_WORDS = ["ve", "ile", "için", "bir", "the", "li", "lı", "lu", "lük", "çok", "en", "de", "da", "modeli", "seti"]

# Clusters of words that stand for one another.
SYNONYMS = [
    ["ayakkabı", "ayakkabi", "sneaker", "bot", "babet", "stiletto", "çizme", "cizme", "terlik", "panduf"],
    ["mont", "kaban", "ceket", "hırka", "hirka", "parka", "pardösü", "pardesu", "yağmurluk", "yagmurluk"],
    ["tişört", "tisort", "t-shirt", "tshirt", "bluz", "body", "sweatshirt", "sweat"],
    ["pantolon", "jean", "kot", "tayt", "şort", "sort", "denim"],
    ["çanta", "canta", "sırt çantası", "sirt cantasi", "valiz", "bavul", "portföy", "portfoy"],
    ["parfüm", "parfum", "edp", "edt", "deodorant", "koku"],
    ["ruj", "lip gloss", "lipgloss", "dudak parlatıcısı", "dudak parlaticisi"],
    ["saat", "kol saati"],
]
COLOR_SYNONYMS = [["altın", "altin", "sarı", "sari"], ["gümüş", "gumus", "gri"], ["bordo", "kırmızı", "kirmizi"], ["lacivert", "mavi"]]
MATERIAL_SYNONYMS = [["kot", "denim"], ["triko", "örgü", "orgu", "orgo", "yün", "yun", "akrilik"]]
# Phrases in which a colour word is none.
COLOR_COLLOCATIONS = ["beyaz eşya", "beyaz esya", "yeşil çay", "yesil cay", "altın çilek", "altin cilek", "gümüş şampuan", "gumus sampuan", "kırmızı et", "kirmizi et"]

# Attribute keys and the words that count under them. Entries of two words never match a token.
COLOR_KEYS = ["renk", "color detail", "kasa renk", "kordon renk", "kadran renk"]
MATERIAL_KEYS = ["materyal", "materyal bileşeni", "kumaş tipi", "kasa materyali", "kordon materyali"]
PATTERN_KEYS = ["desen"]
COLORS = [
    "siyah", "beyaz", "kırmızı", "kirmizi", "mavi", "lacivert", "yeşil", "yesil", "sarı", "sari",
    "turuncu", "mor", "pembe", "gri", "kahverengi", "bej", "bordo", "altın", "altin", "gümüş",
    "gumus", "gold", "füme", "fume", "haki", "turkuaz", "krem", "ekru", "antrasit", "çok renkli",
    "cok renkli", "karışık", "karisik", "taba", "hardal", "petrol", "indigo", "mint", "somon",
    "rose gold", "rose", "kırık beyaz", "buz mavisi", "gece mavisi", "vizon",
]
MATERIALS = [
    "pamuk", "pamuklu", "polyester", "deri", "süet", "suet", "keten", "yün", "yun", "ipek",
    "viskon", "akrilik", "naylon", "metal", "ahşap", "ahsap", "cam", "plastik", "seramik",
    "porselen", "gümüş", "gumus", "altın", "altin", "çelik", "celik", "alüminyum", "aluminyum",
    "kauçuk", "kaucuk", "silikon", "kristal", "taş", "tas", "kumaş", "kumas", "triko", "kot",
    "jean", "likra", "elastan", "modal", "deri", "kadife", "şönil", "sonil", "file", "tül", "tul",
]
PATTERNS = [
    "düz", "duz", "çizgili", "cizgili", "ekose", "puantiyeli", "çiçekli", "ciçekli", "geometrik",
    "kareli", "leopar", "yılan", "yilan", "kamuflaj", "batik", "damalı", "damali", "mix", "desenli",
    "karışık", "karisik", "soyut",
]

# Words that tell whom a query or title is for, and the catalog's own labels.
GENDER_WORDS = {"kadın": "kadın", "kadin": "kadın", "bayan": "kadın", "erkek": "erkek", "bay": "erkek", "unisex": "unisex"}
AGE_WORDS = {
    "çocuk": "cocuk", "cocuk": "cocuk", "kız": "cocuk", "kiz": "cocuk", "oğlan": "cocuk", "oglan": "cocuk",
    "bebek": "bebek", "genç": "genc", "genc": "genc", "yetişkin": "yetiskin", "yetiskin": "yetiskin",
}
GENDER_LABELS = {"kadın": "kadın", "erkek": "erkek", "unisex": "unisex", "unknown": "unknown"}
AGE_LABELS = {"yetişkin": "yetiskin", "çocuk": "cocuk", "bebek": "bebek", "genç": "genc", "bebek & çocuk": "bebek_cocuk", "unknown": "unknown"}

# Words of queries that fit almost anything, and brand strings that name no brand.
GENERIC_WORDS = ["hediye", "hediyesi", "sus", "susu", "aksesuar", "aksesuari", "dekor", "dekoru", "hediyelik", "seti", "set"]
NOT_BRANDS = [
    "kız", "erkek", "çocuk", "bebek", "siyah", "beyaz", "mavi", "kırmızı", "yeşil", "sarı", "gri", "pembe",
    "mor", "turuncu", "lacivert", "deri", "pamuk", "keten", "ipek", "spor", "klasik", "büyük", "küçük", "yeni",
    "eski", "su", "ip", "el", "ev", "al", "ay", "ak", "en", "tek", "bir", "store", "home", "life", "pro", "as",
    "star", "plus", "fit", "wear", "art", "design", "style", "kadın", "gold", "cam", "mont", "ses", "kahve",
    "servis", "oto", "bayrak", "mutfak", "ayna", "kremi", "tasarım", "kupa", "marka", "doğan", "peluş",
]

# Sizes as written and as meant; the single letters and the numbers count beside a trigger word.
SIZES = {"xs": "xs", "xl": "xl", "xxl": "xxl", "2xl": "xxl", "xxxl": "xxxl", "3xl": "xxxl", "4xl": "xxxxl", "xxxxl": "xxxxl"}
SIZE_LETTERS = ["s", "m", "l"]
SIZE_TRIGGERS = ["beden", "numara", "no"]
SIZE_NUMBERS = (34, 52)

# School subjects of the rules and of the guards, which differ.
RULE_SUBJECTS = ["fizik", "kimya", "biyoloji", "matematik", "geometri", "tarih", "coğrafya", "edebiyat", "türkçe", "ingilizce", "almanca", "felsefe"]
GUARD_SUBJECTS = ["fizik", "kimya", "biyoloji", "matematik", "türkçe", "tarih", "coğrafya", "edebiyat", "ingilizce", "felsefe", "geometri", "fen"]
# How many people a bed or sofa word stands for.
CAPACITY_WORDS = {"tek": "1", "tekli": "1", "çift": "2", "ikili": "2", "üçlü": "3", "dörtlü": "4"}
