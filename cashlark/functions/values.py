"""Vocabularies, tokens, limits and zones that results depend on."""

# Payment methods in order of precedence, with the substrings that name them.
PAYMENT_TOKENS = {
    "store_credit": ["credito em loja", "shopify store credit", "store credit", "shopify_store_credit"],
    "pix": ["pix", "starkbank"],
    "boleto": ["boleto", "bank slip"],
    "bank_transfer": ["transferencia", "bank transfer", "ted", "doc", "wire"],
    "credit_card": ["cartao de credito", "credit card", "appmax", "visa", "master", "amex", "elo"],
    "wallet": ["carteira digital", "wallet", "paypal", "mercado pay", "apple pay", "google pay"],
    "cash": ["dinheiro", "cash"],
}
PAYMENT_METHODS = [*PAYMENT_TOKENS, "other"]

# What each method is called where no text names it.
PAYMENT_LABELS = {
    "credit_card": "Cartão de crédito",
    "pix": "Pix",
    "store_credit": "Crédito em loja",
    "boleto": "Boleto",
    "bank_transfer": "Transferência",
    "wallet": "Carteira digital",
    "cash": "Dinheiro",
    "other": "Outro",
}
UNKNOWN_PAYMENT = "Não informado"

# Spellings of store credit, words of a tag that name a payment, words of a note that do, and names of note attributes.
STORE_CREDIT_NAMES = ["shopify_store_credit", r"store\s*credit", r"credito\s*em\s*loja", r"crédito\s*em\s*loja"]
TAG_WORDS = [
    "pix", "starkbank", r"store\s*credit", "shopify_store_credit", r"credito\s*em\s*loja", r"crédito\s*em\s*loja", "visa", "master", "amex", "elo", "card", "cartao", "cartão", "boleto",
    "ted", "doc", "transfer", "paypal", "wallet", "cash", "dinheiro", "appmax",
]
NOTE_WORDS = ["pix", "boleto", "ted", "doc", "transfer", "visa", "master", "elo", "amex", "card", "paypal"]
ATTRIBUTE_WORDS = ["payment", "metodo", "forma", "gateway"]

# Reasons of failures in order of precedence, with the patterns that name them.
FAILURE_PATTERNS = {
    "timeout": "timeout|timed out",
    "invalid_date": "date|invalid.*occurredAt",
    "database_error": "connection|database|socket|prisma",
    "constraint_error": "unique|constraint",
}
OTHER_FAILURE = "unknown_error"

# Letters with accents and their plain forms, and characters that count as white space.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
WHITE = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Marketplace keys with labels, and older names of some keys.
MARKETPLACE_LABELS = {
    "shopify": "Shopify",
    "mercado_livre": "Mercado Livre",
    "shopee": "Shopee",
    "netshoes": "Netshoes",
    "tiktok_shop": "TikTok Shop",
    "amazon_global_api": "Amazon",
}
MARKETPLACE_ALIASES = {"amazon": "amazon_global_api", "tiktok": "tiktok_shop"}

# Sources, kinds and states.
STOREFRONT, HUB = "shopify", "anymarket"
PAID_KINDS = ["sale", "capture", "change"]
STORE_CREDIT_GATEWAY = "Crédito em loja"
NO_GATEWAY = "sem_gateway"
OPEN_STATES = ["pendente", "persistente"]
CLOSED_STATES = ["corrigido", "sem_correcao", "aceito"]
DIVERGENCE_STATES = ["pendente", "persistente", "corrigido", "sem_correcao", "aceito", "ignorado"]
RETRY_DAYS = [1, 2, 4, 8]
RETRY_SECONDS = [0, 30, 300, 900, 3600]
SHIPPING_BOUNDS = (-50_000, 1_000_000)

# Zones of business days and of verification days.
BUSINESS_ZONE, VERIFICATION_ZONE = "America/Sao_Paulo", "America/Bahia"
#: The days that a materialisation covers begin at this fixed offset.
BUSINESS_OFFSET = "-03:00"

# How scheduled runs are told from manual ones, and limits of their health.
SCHEDULED_PREFIX = "cf-cron-"
RUN_WINDOW_MINUTES, STUCK_FACTOR = 24 * 60 + 15, 2
