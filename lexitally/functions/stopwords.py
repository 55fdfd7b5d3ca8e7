"""The stop list. Results depend on exactly these 68 words."""

MARKUP = (
    "quot gt lt amp ref br span div small ul wul html class style align nbsp "
    "http https www px org com"
)
TEMPLATE_FIELDS = (
    "date user web url title name category cite archive talk access link news coibot domain "
    "utc otherlinks center page color website publisher base article background redirect "
    "language id basedomain baseip wikipedia"
)
SINGLE_LETTERS = "s x u l d c b f e w m p de r t"

STOP_WORDS: tuple[str, ...] = tuple(f"{MARKUP} {TEMPLATE_FIELDS} {SINGLE_LETTERS}".split())
