"""Synthetic labelled findings, made from small tables without any state.

The model: a finding is a *form* (how a value looks) in a *medium* (what it stands in). Forms are issued tokens of
published formats, raw key material (an encoding and a number of bytes), texts that people choose, key blocks and
structured credentials. Media are assignments (an opening, a sign, a closing), headers, shell lines, links with user
information, messages in ten languages and blocks. A true finding is a form in a medium that it fits. A false one keeps
the medium and puts a stand-in, a reference, a mask or an identifier in the value's place, or is prose. One for review has
a value that a reader cannot settle: hidden in part, cut, digested, retired, a fallback, or without any medium.

A row is its number; every choice is a digest of seed, slot and row, so any partition can be made again alone. Rows are
described once, and an :class:`Ink` writes the description as SQL expressions; another dialect needs another ink only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate, product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivet.functions.text import draw

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX, BASE32, ALNUM = DIGITS + "abcdef", UPPER + "234567", UPPER + LOWER + DIGITS
BASE64, BASE64URL, PRINTABLE = ALNUM + "+/", ALNUM + "-_", ALNUM + "!#%&()*+,-.:;?@_~"

#: Formats that issuers publish, as fixed letters and (alphabet, length).
ISSUED: tuple[tuple[str, tuple], ...] = (
    ("aws_access_key_id", ("AKIA", (BASE32, 16))),
    ("github_pat", ("ghp_", (ALNUM, 36))),
    ("github_app_token", ("ghs_", (ALNUM, 36))),
    ("gitlab_pat", ("glpat-", (BASE64URL, 20))),
    ("npm_token", ("npm_", (ALNUM, 36))),
    ("pypi_token", ("pypi-AgEIcHlwaS5vcmc", (BASE64URL, 70))),
    ("slack_bot_token", ("xoxb-", (DIGITS, 12), "-", (DIGITS, 12), "-", (ALNUM, 24))),
    ("gcp_api_key", ("AIza", (BASE64URL, 35))),
    ("stripe_live_key", ("sk_live_", (ALNUM, 24))),
    ("sendgrid_key", ("SG.", (BASE64URL, 22), ".", (BASE64URL, 43))),
    ("vault_service_token", ("hvs.", (BASE64URL, 24))),
    ("docker_pat", ("dckr_pat_", (BASE64URL, 27))),
    ("hugging_face_token", ("hf_", (ALNUM, 34))),
    ("jwt", ("eyJhbGciOiJIUzI1NiJ9.eyJ", (BASE64URL, 48), ".", (BASE64URL, 43))),
)
#: Raw key material: every encoding at every size in bytes; its length follows.
ENCODINGS = {"hex": (HEX, lambda n: 2 * n), "base32": (BASE32, lambda n: -(-8 * n // 5)), "base64url": (BASE64URL, lambda n: -(-4 * n // 3))}
SIZES = (16, 20, 24, 32, 48, 64)
#: Labels of key blocks. RFC 7468, RFC 4880 and common practice.
BLOCKS = ("PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "EC PRIVATE KEY", "RSA PRIVATE KEY", "DSA PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK")
STRUCTURED: tuple[tuple[str, tuple], ...] = (
    ("service_account_json", ('{"kind": "robot", "id": "', (HEX, 24), '", "material": "', (BASE64, 88), '"}')),
    ("storage_settings", ("Account=", (LOWER, 9), ";Secret=", (BASE64, 86), "==;Secure=true")),
    ("signed_query", ("expires=", (DIGITS, 10), "&scope=read&sign=", (BASE64URL, 43))),
    ("webhook_link", ("https://hooks.example.net/in/", (UPPER, 9), "/", (ALNUM, 24))),
    ("assertion", ("PHNhbWxwOlJlc3BvbnNl", (BASE64, 180))),
)
PLACES_OF = {"issued": "assign header shell message", "raw": "assign header message", "chosen": "assign shell link message", "block": "block", "structured": "assign"}

WORDS = ("anchor", "birch", "canyon", "drizzle", "ember", "falcon", "glacier", "hazel", "island", "jigsaw", "kettle", "lagoon", "mosaic", "nectar", "orbit", "pebble")
FIRST, LAST = ("ana", "bo", "chidi", "dara", "elif", "femi", "gita", "hugo"), ("abel", "brandt", "cruz", "dupont", "eze", "ferrari", "gupta", "haas")
SYSTEMS = ("archive", "booking", "checkout", "dispatch", "estimates", "forecast", "gateway", "helpdesk")
NAMES = ("db_password", "service_secret", "api_token", "signing_key", "smtp_pass", "client_secret", "backup_passphrase", "deploy_token", "session_key", "admin_pwd")
SYMBOLS = "!#%&*+-?@_"
#: Look-alike digits of letters.
LOOKS = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7"}
#: Assignments: opening, sign and closing around a name and its value.
ASSIGN = (
    ("", "=", ""), ("export ", "='", "'"), ("  ", ": ", ""), ('  "', '": "', '",'), ("set ", " ", ""), ("<entry name=\"", '">', "</entry>"),
    ("let ", ' = "', '";'), ("", " := `", "`"), ("-- ", " => '", "'"), ("private static final String ", ' = "', '";'), ("[secrets]\n", ' = "', '"'), ("ENV ", "=", ""),
)
HEADERS = ("Authorization: Bearer ", "Authorization: token ", "X-Auth-Key: ", "Proxy-Authorization: Bearer ", "Cookie: session=")
#: Shell lines; {u} is a user, {v} the value, {h} a host.
SHELL = ("curl --user {u}:{v} https://{h}/status", "psql \"host={h} user={u} password={v}\"", "mysql -h {h} -u {u} -p{v}", "rclone copy --ftp-pass {v} {h}: .", "vault login -address=https://{h} {v}")
SCHEMES = ("postgresql", "mysql", "mongodb+srv", "redis", "amqps", "ftp", "ldaps", "smtp")
#: Languages: words for a password, stand-ins, a sentence that tells a value and one that tells none; {n} is the word, {v}
#: the value, {s} a system, {t} a ticket, {d} a date, {a} an account.
LANGUAGES = {
    "en": (("password", "passphrase"), ("enter-password-here", "to-be-set"), "for {s} use the {n} {v} from now on ({t})", "on {d} the {n} rules for {a} were read out again"),
    "fr": (("mot-de-passe", "code"), ("a-remplir", "saisir-ici"), "pour {s}, le {n} est desormais {v} ({t})", "le {d}, rappel des regles de {n} pour {a}"),
    "de": (("Passwort", "Zugangscode"), ("hier-eintragen", "noch-offen"), "ab jetzt gilt fuer {s} {n} {v} ({t})", "am {d} wurden die Regeln zum {n} von {a} erklaert"),
    "es": (("clave", "contrasenia"), ("completar-aqui", "pendiente"), "para {s} la {n} pasa a ser {v} ({t})", "el {d} se repasaron las reglas de {n} de {a}"),
    "it": (("parola-chiave", "codice"), ("inserire-qui", "da-definire"), "per {s} ora vale {n} {v} ({t})", "il {d} sono state lette le regole per {n} di {a}"),
    "pt": (("senha", "palavra-passe"), ("preencher-aqui", "por-definir"), "em {s} a {n} agora e {v} ({t})", "em {d} as regras de {n} de {a} foram lidas"),
    "nl": (("wachtwoord", "toegangscode"), ("hier-invullen", "nog-bepalen"), "voor {s} geldt nu {n} {v} ({t})", "op {d} zijn de regels voor {n} van {a} besproken"),
    "pl": (("haslo", "kod"), ("wpisz-tutaj", "do-ustalenia"), "dla {s} obowiazuje {n} {v} ({t})", "{d} omowiono zasady {n} konta {a}"),
    "tr": (("parola", "erisim-kodu"), ("buraya-yazin", "belirlenecek"), "{s} icin yeni {n}: {v} ({t})", "{d} gunu {a} icin {n} kurallari okundu"),
    "sv": (("losenord", "kod"), ("fyll-i-har", "ej-bestamt"), "for {s} galler nu {n} {v} ({t})", "den {d} gicks reglerna for {n} till {a} igenom"),
}
#: References to a value that stands elsewhere; {k} is its name.
REFERENCES = ("${{k}}", "%{k}%", "{{ secrets.{k} }}", "$({k})", "env(\"{k}\")", "@Microsoft.KeyVault({k})")
MASKS = tuple(mark * n for mark, n in product("*x#.", (6, 8, 12)))
#: Identifiers that are no secrets, and the words before them.
IDENTIFIERS: tuple[tuple[str, str, tuple], ...] = (
    ("order_number", "order ", ("ORD", (DIGITS, 9))),
    ("revision", "built from revision ", ((HEX, 40),)),
    ("trace_id", "trace ", ((HEX, 8), "-", (HEX, 4), "-", (HEX, 4), "-", (HEX, 4), "-", (HEX, 12))),
    ("test_mode_key", "sandbox key ", ("sk_test_", (ALNUM, 24))),
    ("account_number", "sample account ", ("NL00BANK", (DIGITS, 10))),
    ("parcel", "parcel ", ((UPPER, 2), (DIGITS, 11), (UPPER, 2))),
)
DOMAINS, ACCOUNTS, TICKETS = ("lab.example", "plant.example.net", "shop.example.org"), ("LAB", "PLANT", "SHOP"), ("OPS", "HELP", "REQ")
CONTEXT_CHARS = 512
#: What texts tell about the place they come from: domains below a host's own label, domains of accounts, ticket
#: prefixes, and names that something is assigned to.
MINED = {
    "domain": r"\b[a-z][a-z0-9-]*\.((?:[a-z0-9-]+\.)+[a-z]{2,})\b",
    "account": r"\b([A-Z][A-Z0-9-]{1,14})\\[A-Za-z]",
    "ticket": r"\b([A-Z]{2,6})-?\d{4,}\b",
    "name": r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\s*[=:]",
}
#: The same words in Java's dialect, where ``\b`` also minds letters beyond ASCII, ``\s`` takes a vertical tab and a group that repeats
#: needs stack for each turn. In texts of :func:`dots_apart` labels and dots are one repeated class; where no domain comes behind a
#: label and its dot, what follows is passed over and the word is empty, so no stretch is tried twice.
MINED_BY_JAVA = {
    "domain": r"[a-z](?<!\w.)[a-z0-9-]*+\.(?:([a-z0-9-][a-z0-9.-]*(?<=\.)[a-z]{2,}+(?!\w))|[a-z0-9-][a-z0-9.-]*+)",
    "account": r"([A-Z](?<!\w.)[A-Z0-9-]{1,14})\\[A-Za-z]",
    "ticket": r"([A-Z](?<!\w.)[A-Z]{1,5})-?\d{4,}+(?!\w)",
    "name": r"([A-Z](?<!\w.)[A-Z0-9]*+(?:_[A-Z0-9]++)++)[\t\n\f\r ]*+[=:]",
}


def casings(name: str) -> list[str]:
    """A name in six casings."""
    parts = name.split("_")
    pascal = "".join(p.capitalize() for p in parts)
    return [name, name.upper(), "-".join(parts), ".".join(parts), pascal, pascal[0].lower() + pascal[1:]]


def look_alikes(word: str) -> list[str]:
    """The word with any of its letters that look like digits replaced."""
    at = [i for i, c in enumerate(word) if c in LOOKS]
    return ["".join(LOOKS[c] if i in chosen else c for i, c in enumerate(word)) for chosen in ({at[k] for k in range(len(at)) if bits >> k & 1} for bits in range(1 << len(at)))]


class Ink:
    """Writes expressions of row ``n`` as Spark SQL text. ``slot`` names a choice; the same slot is the same draw."""

    def __init__(self, seed: int):
        self.seed, self._bound = seed, 0

    def lit(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def col(self, name: str) -> str:
        return name

    def cat(self, *parts: str) -> str:
        return "(" + " || ".join(parts) + ")"

    def draw(self, n: int, slot: str, *more: str) -> str:
        """The number that :func:`trivet.functions.text.draw` gives for seed, slot and row."""
        return f"pmod(cast(conv(substr(md5(concat_ws('|', '{self.seed}', '{slot}', n{''.join(', ' + m for m in more)})), 1, 15), 16, 10) as bigint), {n})"

    def choose(self, arms: Sequence[str], slot: str, weights: Sequence[int] | None = None) -> str:
        ends = list(accumulate(weights or [1] * len(arms)))
        self._bound += 1
        p = f"p{self._bound}"
        case = " ".join(f"WHEN {p} < {end} THEN {arm}" for end, arm in zip(ends, arms[:-1]))
        return self.bind(self.draw(ends[-1], slot), p, f"CASE {case} ELSE {arms[-1]} END" if case else arms[-1])

    def bind(self, value: str, name: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def pick(self, options: Sequence[str], slot: str) -> str:
        return f"element_at(array({', '.join(map(self.lit, options))}), cast({self.draw(len(options), slot)} as int) + 1)"

    def switch(self, on: str, arms: dict[str, str]) -> str:
        return f"CASE {on} " + " ".join(f"WHEN {self.lit(k)} THEN {arm}" for k, arm in arms.items()) + " END"

    def text(self, alphabet: str, n: int, slot: str) -> str:
        return f"array_join(transform(sequence(1, {n}), i -> substr({self.lit(alphabet)}, cast({self.draw(len(alphabet), slot, 'i')} as int) + 1, 1)), '')"

    def part(self, text: str, start: int, n: int) -> str:
        return f"substr({text}, {start}, {n})"

    def known(self, text: str, otherwise: str) -> str:
        return f"coalesce({text}, {otherwise})"


class Writer:
    """Parts of findings in one ink."""

    def __init__(self, ink: Ink):
        self.ink = ink

    def pick(self, options: Sequence[str], slot: str) -> Any:
        return self.ink.pick(options, slot)

    def form(self, parts: tuple, slot: str) -> Any:
        return self.ink.cat(*[self.ink.lit(p) if isinstance(p, str) else self.ink.text(*p, f"{slot}/{i}") for i, p in enumerate(parts)])

    def fill(self, template: str, **slots: Any) -> Any:
        out, rest = [], template
        while rest:
            at, mark = min((rest.find(f"{{{m}}}"), m) if f"{{{m}}}" in rest else (len(rest), "") for m in slots)
            if at:
                out.append(self.ink.lit(rest[:at]))
            if mark:
                out.append(slots[mark])
            rest = rest[at + (len(mark) + 2 if mark else 0) :]
        return self.ink.cat(*out)

    def weighted(self, arms: list[tuple[int, Any]], slot: str) -> Any:
        return self.ink.choose([arm for _, arm in arms], slot, [weight for weight, _ in arms])

    def chosen(self, slot: str) -> dict[str, Any]:
        """What people choose: joined words, a look-alike word with a tail, a capital with year and symbol, typed noise."""
        ink = self.ink
        word, other = self.pick(WORDS, f"{slot}/word"), self.pick([w.capitalize() for w in WORDS], f"{slot}/other")
        tail = ink.cat(ink.text(DIGITS, 2, f"{slot}/digits"), ink.text(SYMBOLS, 1, f"{slot}/symbol"))
        look = ink.choose([self.pick(look_alikes(w), f"{slot}/look") for w in WORDS], f"{slot}/word")
        return {
            "passphrase": ink.cat(word, ink.lit("-"), other, ink.lit("-"), ink.text(DIGITS, 3, f"{slot}/three")),
            "look_alike_password": ink.cat(look, tail),
            "dated_password": ink.cat(other, ink.lit("20"), tail),
            "typed_password": ink.text(PRINTABLE, 15, f"{slot}/typed"),
            "managed_password": ink.text(ALNUM, 20, f"{slot}/managed"),
        }

    def password(self, slot: str) -> Any:
        kinds = self.chosen(slot)
        return self.weighted(list(zip((3, 2, 2, 2, 1), kinds.values())), f"{slot}/kind")

    def forms(self) -> list[tuple[str, str, Any]]:
        """Kind, family and value of every form."""
        ink = self.ink
        out = [(kind, "issued", self.form(parts, kind)) for kind, parts in ISSUED]
        for (name, (alphabet, length)), size in product(ENCODINGS.items(), SIZES):
            out.append((f"raw_{name}_{8 * size}", "raw", ink.text(alphabet, length(size), f"raw/{name}/{size}")))
        out += [(kind, "chosen", value) for kind, value in self.chosen("chosen").items()]
        for label in BLOCKS:
            lines = [ink.cat(ink.text(BASE64, 64, f"block/{label}/{i}"), ink.lit("\n")) for i in range(3)]
            out.append((label.lower().replace(" ", "_"), "block", ink.cat(ink.lit(f"-----BEGIN {label}-----\n"), *lines, ink.lit(f"-----END {label}-----"))))
        return out + [(kind, "structured", self.form(parts, kind)) for kind, parts in STRUCTURED]

    def user(self, slot: str) -> Any:
        ink, first, last = self.ink, self.pick(FIRST, f"{slot}/first"), self.pick(LAST, f"{slot}/last")
        styles = [(4, ink.cat(first, ink.lit("."), last)), (2, ink.cat(last, ink.text(DIGITS, 2, f"{slot}/n"))), (2, ink.cat(ink.lit("svc-"), self.pick(SYSTEMS, f"{slot}/system"))), (1, ink.cat(ink.lit("u"), ink.text(DIGITS, 6, f"{slot}/staff"))), (1, ink.cat(ink.part(first, 1, 1), last))]
        return self.weighted(styles, f"{slot}/style")

    def date(self, slot: str) -> Any:
        ink = self.ink
        d, m, y = (self.pick([f"{i:02d}" for i in span], f"{slot}/{k}") for k, span in (("d", range(1, 29)), ("m", range(1, 13)), ("y", range(19, 27))))
        year = ink.cat(ink.lit("20"), y)
        dash, dot, slash = (ink.lit(x) for x in "-./")
        return ink.choose([ink.cat(year, dash, m, dash, d), ink.cat(d, dot, m, dot, year), ink.cat(d, slash, m, slash, year), ink.cat(year, slash, m, slash, d)], f"{slot}/order")

    def shared(self) -> dict[str, Any]:
        """Columns that every label's contexts may need. Mined words, where there are any, come as ``mined_*``."""
        ink = self.ink
        domain = ink.known(ink.col("mined_domain"), self.pick(DOMAINS, "domain"))
        return {
            "who": self.user("who"),
            "host": ink.cat(self.pick(SYSTEMS, "server"), ink.text(DIGITS, 2, "server number"), ink.lit("."), domain),
            "name": ink.known(ink.col("mined_name"), self.pick([c for n in NAMES for c in casings(n)], "name")),
            "ticket": ink.cat(ink.known(ink.col("mined_ticket"), self.pick(TICKETS, "ticket")), ink.lit("-"), ink.text(DIGITS, 6, "ticket number")),
            "account": ink.cat(ink.known(ink.col("mined_account"), self.pick(ACCOUNTS, "account")), ink.lit("\\"), self.user("account user")),
        }

    def by_language(self, which: int, value: Any) -> Any:
        ink = self.ink
        slots = {"v": value, "s": self.pick(SYSTEMS, "system"), "t": ink.col("ticket"), "d": self.date("date"), "a": ink.col("account")}
        return ink.choose([self.fill(words[which], n=self.pick(words[0], "noun"), **slots) for words in LANGUAGES.values()], "language")

    def assigned(self, value: Any) -> Any:
        ink, name = self.ink, self.ink.col("name")
        return ink.choose([ink.cat(ink.lit(a), name, ink.lit(b), value, ink.lit(c)) if a else ink.cat(name, ink.lit(b), value, ink.lit(c)) for a, b, c in ASSIGN], "assignment")

    def real(self) -> list[dict[str, Any]]:
        """Stages of a true finding."""
        ink, forms = self.ink, self.forms()
        v, who, host = ink.col("password"), ink.col("who"), ink.col("host")
        media = {
            "assign": self.assigned(v),
            "header": ink.cat(self.pick(HEADERS, "header"), v),
            "shell": ink.choose([self.fill(s, u=who, v=v, h=host) for s in SHELL], "shell"),
            "link": ink.cat(self.pick(SCHEMES, "scheme"), ink.lit("://"), who, ink.lit(":"), v, ink.lit("@"), host, ink.lit("/"), self.pick(SYSTEMS, "path")),
            "message": self.by_language(2, v),
            "block": ink.cat(ink.lit("# "), host, ink.lit("\n"), v),
        }
        families = {family: self.pick(PLACES_OF[family].split(), "medium") for family in PLACES_OF}
        medium = ink.col("medium")
        return [
            {**self.shared(), "category": self.pick([kind for kind, _, _ in forms], "form"), "family": self.pick([family for _, family, _ in forms], "form")},
            {"password": ink.switch(ink.col("category"), {kind: value for kind, _, value in forms}), "medium": ink.switch(ink.col("family"), families)},
            {"context": ink.switch(medium, media), "username": ink.switch(medium, {m: who if m in ("link", "shell") else ink.lit("") for m in media})},
        ]

    def false(self) -> list[dict[str, Any]]:
        """Stages of a false finding; an identifier or an account stands in the user's place."""
        ink, langs, way, stand = self.ink, LANGUAGES.values(), self.ink.col("way"), self.ink.col("stand")
        none = ink.lit("")
        weights = {"stand_in": 3, "reference": 2, "mask": 1, "identifier": 3, "rules": 2, "reset_link": 1}
        stands = {
            "stand_in": ink.choose([self.pick(w[1], "stand-in") for w in langs], "language"),
            "reference": ink.choose([self.fill(r, k=ink.cat(self.pick([s.upper() for s in SYSTEMS], "reference system"), ink.lit("_SECRET"))) for r in REFERENCES], "reference"),
            "mask": self.pick(MASKS, "mask"),
            "identifier": ink.choose([self.form(parts, kind) for kind, _, parts in IDENTIFIERS], "identifier"),
            "rules": ink.col("account"),
            "reset_link": ink.cat(ink.lit("https://"), ink.col("host"), ink.lit("/renew?id="), ink.text(HEX, 10, "renewal")),
        }
        names = {"stand_in": self.pick([f"stand_in_{x}" for x in LANGUAGES], "language"), "rules": self.pick([f"rules_{x}" for x in LANGUAGES], "language"), "identifier": self.pick([kind for kind, _, _ in IDENTIFIERS], "identifier")}
        before = self.pick([before for _, before, _ in IDENTIFIERS], "identifier")
        return [
            {**self.shared(), "way": self.weighted([(n, ink.lit(k)) for k, n in weights.items()], "way"), "password": none},
            {"stand": ink.switch(way, stands), "prose": self.by_language(3, none), "category": ink.switch(way, {k: names.get(k, ink.lit(k)) for k in weights})},
            {"assigned": self.assigned(stand)},
            {
                "context": ink.switch(way, {k: {"identifier": ink.cat(before, stand, ink.lit("; "), ink.col("prose")), "rules": ink.col("prose"), "reset_link": ink.cat(ink.lit("reset link: "), stand)}.get(k, ink.col("assigned")) for k in weights}),
                "username": ink.switch(way, {k: stand if k in ("identifier", "rules") else none for k in weights}),
            },
        ]

    def review(self) -> list[dict[str, Any]]:
        """Stages of a finding that a reader cannot settle."""
        ink, secret, way = self.ink, self.ink.col("secret"), self.ink.col("category")
        v, name = ink.col("password"), ink.col("name")
        values = {
            "hidden_part": ink.cat(ink.part(secret, 1, 2), ink.lit("*****"), ink.part(secret, -2, 2)),
            "cut_off": ink.cat(ink.lit("ghp_"), ink.text(ALNUM, 9, "cut"), ink.lit("...")),
            "digest": ink.text(HEX, 64, "digest"),
            "retired": secret,
            "fallback": secret,
            "no_medium": secret,
            "plausible_example": ink.cat(ink.lit("Example"), ink.text(DIGITS, 4, "example"), ink.text(SYMBOLS, 1, "example symbol")),
        }
        contexts = {
            "cut_off": ink.cat(ink.lit("request failed, token "), v, ink.lit(" refused by "), ink.col("host")),
            "digest": ink.cat(name, ink.lit(" (sha256): "), v),
            "retired": ink.cat(ink.lit("until "), self.date("date"), ink.lit(" it was "), v, ink.lit(", see "), ink.col("ticket")),
            "fallback": ink.cat(name, ink.lit("=${OVERRIDE:-"), v, ink.lit("}")),
            "no_medium": ink.cat(ink.col("who"), ink.lit(" "), v),
        }
        return [
            {**self.shared(), "secret": self.password("secret"), "category": self.pick(list(values), "way")},
            {"password": ink.switch(way, values)},
            {"assigned": self.assigned(v)},
            {"context": ink.switch(way, {k: contexts.get(k, ink.col("assigned")) for k in values}), "username": ink.switch(way, {k: ink.col("who") if k == "no_medium" else ink.lit("") for k in values})},
        ]


LABELS = {"REAL": Writer.real, "FALSE_POSITIVE": Writer.false, "REVIEW": Writer.review}


def dots_apart(text: Column) -> Column:
    """A space between dots that meet: no domain goes over two dots, so none is gained or lost."""
    return F.when(F.contains(text, F.lit("..")), F.regexp_replace(text, r"\.(?=\.)", ". ")).otherwise(text)


def mine_vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, value, n``: every distinct word of :data:`MINED` that texts hold and in how many texts; one pass over the
    texts, counted before words move. Null and empty texts have none."""
    of = lambda kind: dots_apart(F.col(text_col)) if kind == "domain" else F.col(text_col)
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all(of(k), F.lit(p), F.lit(1))).alias("v")) for k, p in MINED_BY_JAVA.items()])
    rows = texts.filter(F.col(text_col).isNotNull()).select(F.explode(found).alias("x")).select("x.kind", F.explode("x.v").alias("value")).filter("value <> ''")
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def numbered(vocabulary: DataFrame) -> DataFrame:
    """``kind, value, i``: words of a kind numbered from 0. Words are counted in 4096 ranges of their digest, so only
    ranges are put in order."""
    words = vocabulary.select("kind", "value").distinct().withColumn("_r", F.conv(F.substring(F.md5("value"), 1, 3), 16, 10).cast("int"))
    before = F.sum("count").over(Window.partitionBy("kind").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    starts = words.groupBy("kind", "_r").count().withColumn("_s", F.coalesce(before, F.lit(0))).select("kind", "_r", "_s")  # 4096 rows a kind
    place = F.row_number().over(Window.partitionBy("kind", "_r").orderBy("value")) - 1
    return words.withColumn("_at", place).join(F.broadcast(starts), ["kind", "_r"]).select("kind", "value", (F.col("_s") + F.col("_at")).alias("i"))


def findings(spark: SparkSession, label: str, count: int, seed: int, words: DataFrame | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """``n, context, username, password, label, category`` of rows 0 to ``count`` - 1. Mined words come by joins on a
    drawn number."""
    rows = spark.range(count).withColumnRenamed("id", "n")
    for kind in MINED:
        size = (sizes or {}).get(kind, 0)
        if not size:
            rows = rows.withColumn(f"mined_{kind}", F.lit(None).cast("string"))
            continue
        own = words.filter(F.col("kind") == kind).select(F.col("i").alias("_i"), F.col("value").alias(f"mined_{kind}"))
        rows = rows.withColumn("_d", draw(size, seed, label, "mined", kind, F.col("n"))).join(own, F.col("_d") == F.col("_i"), "left").drop("_d", "_i")
    for stage in LABELS[label](Writer(Ink(seed))):
        rows = rows.withColumns({name: F.expr(text) for name, text in stage.items()})
    null = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return rows.select("n", F.substring("context", 1, CONTEXT_CHARS).alias("context"), null("username"), null("password"), F.lit(label).alias("label"), "category")


def generate(spark: SparkSession, n_true: int = 4000, n_false: int = 4000, n_review: int = 700, seed: int = 42, vocabulary: DataFrame | None = None, extra: float = 1.5, most: float = 60.0) -> DataFrame:
    """``context, username, password, label, category`` with contexts that are unique over all labels (true ones go
    first). More rows than wanted are made, at once; a label that still lacks some is made again with twice as many, up
    to ``most`` times the wanted number. ``vocabulary`` is that of :func:`mine_vocabulary`; kinds that it lacks, and all
    without it, come from built-in words."""
    wanted = {"REAL": n_true, "FALSE_POSITIVE": n_false, "REVIEW": n_review}
    words = numbered(vocabulary) if vocabulary is not None else None
    sizes = {r["kind"]: r["count"] for r in words.groupBy("kind").count().collect()} if words is not None else {}
    cols = ["n", "username", "password", "label", "category"]
    while True:
        parts = [findings(spark, label, int(n * extra) + 20 if n else 0, seed, words, sizes).withColumn("rank", F.lit(rank)) for rank, (label, n) in enumerate(wanted.items())]
        every = reduce(DataFrame.unionByName, parts)
        unique = every.groupBy("context").agg(F.min_by(F.struct(*cols), F.struct("rank", "n")).alias("r")).select("context", "r.*")
        have = {r.label: r["count"] for r in unique.groupBy("label").count().collect()}
        if extra >= most or all(have.get(k, 0) >= n for k, n in wanted.items()):
            break
        extra *= 2
    # Rows of a label are taken by their numbers. They are counted in ranges of numbers, so only ranges are put in order.
    limits = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    width = max(1, int(max(wanted.values()) * extra) // 1024)
    ranged = unique.withColumn("_b", F.floor(F.col("n") / width))
    counts = ranged.groupBy("label", "_b").count()
    before = F.sum("count").over(Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("label", "_b", F.coalesce(before, F.lit(0)).alias("_s"))  # about 1024 rows a label
    place = F.col("_s") + F.row_number().over(Window.partitionBy("label", "_b").orderBy("n"))
    rows = ranged.join(F.broadcast(starts), ["label", "_b"]).withColumn("_p", place)
    return rows.filter(F.col("_p") <= limits[F.col("label")]).select("context", "username", "password", "label", "category")
