"""Word lists and label sets. Results depend on exactly these entries."""

# Indonesian-only and Malaysian-only markers.
INDONESIAN_MARKERS = (
    "bisa", "mobil", "kamu", "mau", "kenapa sih", "sepeda", "ban", "cewek", "cowok", "ngomong", "bicara", "kantor", "bilang",
    "gimana", "banget", "nggak", "enggak", "udah", "aja", "doang", "kayak", "bikin", "ngapain", "lu", "gue", "sih", "dong",
    "kok", "deh", "nih", "tuh", "banget banget",
)
MALAYSIAN_MARKERS = (
    "kereta", "basikal", "tayar", "pejabat", "cakap", "jom", "kedai", "wang", "cikgu", "rasuah", "gaduh",
    "nak", "tak", "dah", "je", "korang", "awak", "macam mana", "apa khabar", "sahaja", "boleh", "tengok", "kat",
)

# Function words of English and Malay.
ENGLISH_WORDS = tuple(
    "the a an and or but if then than that this these those is are was were be been being have has had do does did will would "
    "can could should of to in on at for with from by about into over after before you your they them we our it its not no yes".split()
)
MALAY_WORDS = tuple(
    "yang dan atau tetapi jika maka daripada itu ini adalah ialah ada sudah telah akan boleh dapat harus mesti untuk dengan dari "
    "oleh pada di ke kepada saya awak anda mereka kami kita dia tak tidak ya bukan sangat juga lagi sahaja saja".split()
)

# Markers of each dialect, in the order that settles ties.
DIALECT_MARKERS = {
    "kelantan": tuple("gapo demo kito ambo tubik gok kkecek ttubik sokmo doh nnate koho".split()),
    "kedah": tuple("hang depa hampa pi mai tak dan cek awat pasaipa".split()),
    "terengganu": tuple("dokrok mung starang lok bakpe ceroh htok".split()),
    "sarawak": tuple("kamek kitak sik nemu bok aok gerek".split()),
    "sabah": tuple("bah kitak palui gia banar sia".split()),
    "negeri_sembilan": tuple("den ekau opa poi yo".split()),
}

# Classifier labels by language group.
MALAY_LABELS = ("malay", "standard-malay", "local-malay")
MANGLISH_LABELS = ("manglish", "local-english")
ROJAK_LABELS = ("rojak",)
INDONESIAN_LABELS = ("ind", "standard-indonesian", "socialmedia-indonesian")
ENGLISH_LABELS = ("eng", "english", "standard-english")
OTHER_LABELS = ("other", "standard-mandarin", "local-mandarin")

# Names that identify a router module.
ROUTER_PATTERNS = (
    r"\.gate$",
    r"\.router$",
    r"\.router\.(gate|classifier|layer)$",
    r"\.block_sparse_moe\.gate$",
    r"\.mlp\.gate$",
    r"\.moe\.(gate|router)$",
    r"\.experts?\.(gate|router)$",
    r"\.gate_proj_router$",
)
