"""Prompt rendering as Column expressions.

A template is plain text with ``{field}`` placeholders.  ``render`` turns it
into one ``concat`` of literals and columns (constant parts are folded by
Catalyst), so rendering stays inside whole-stage codegen.  Missing values are
rendered as ``None``, like Python string formatting does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt templates and per-language messages.  These must equal
# the reference's strings character for character.
# ---------------------------------------------------------------------------
MT_LID_INFERENCE = "<|reserved_special_token_12|>{src_segm}<|reserved_special_token_13|>"
MT_INFERENCE = ("<|reserved_special_token_12|>{src_segm}<|reserved_special_token_13|>{src_lang}"
                "<|reserved_special_token_14|>{task} to {tgt_lang}<|reserved_special_token_15|>")
MT_TRAIN_MONO = "<|reserved_special_token_12|>{src_segm}<|reserved_special_token_13|>{src_lang}"
MT_TRAIN_PARA = ("<|reserved_special_token_12|>{src_segm}<|reserved_special_token_13|>{src_lang}"
                 "<|reserved_special_token_14|>{task} to {tgt_lang}<|reserved_special_token_15|>{tgt_segm}")

ALPACA_INFERENCE = ("Below is an instruction that describes a task, paired with an input that provides further "
                    "context. Write a response that appropriately completes the request.\n\n"
                    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n")
ALPACA_TRAIN = ALPACA_INFERENCE + "{output}"

CHAT_TEMPLATE = ("<|im_start|>system\n{system_instruction}<|im_end|>\n<|im_start|>user\n{user_instruction}"
                 "<|im_end|>\n<|im_start|>assistant\n")
PIVOT_USER_MESSAGE = "{text_is_in}: {hi_lang}.\n\n{hi_segm}\n\n{postinstruction}"

QC_JUDGE_SYSTEM = ("You are a large language model, whose sole task is to respond to user queries. Think carefully, "
                   "and after careful deliberation respond to the user, following their instructions.")
QC_JUDGE_USER = ("Your task is to detect hallucinations of a translation model. Here is the original input text:\n\n"
                 "{hi_segm}\n\nand this next here should be its translation into {new_hi_res_lang}:\n\n"
                 "{hyp-translation}\n\nThink carefully: is this second text actually a translation of the original "
                 "input text into {new_hi_res_lang}? Respond with yes or no, no additional comments or discussions.")

GEN_TEXT = "Translate:\n== From: {src_lang}\n== To: {tgt_lang}{variety}\n== Input: {text}\n== Output: "
GEN_TEXT_VARIETY = ", variety: "

LEGACY_PARA_A = "{src_segm}\n=====\nis in {src_lang}; {task} to {tgt_lang}:\n{tgt_segm}"
LEGACY_MONO_A = "{src_segm}\n=====\nis in {src_lang}"
LEGACY_PARA_B = "{src_segm}\n=====\n{task} from {src_lang}; to {tgt_lang}:\n{tgt_segm}"
LEGACY_MONO_B = "{src_segm}\n=====\nis in {src_lang};"

# Per output language: system instruction, "text is in" lead, post-instruction.
MESSAGES = {
    "English": (
        "You are a powerful AI translator, the best model to produce translations from any European language into "
        "English. When you are asked to translate, you respond with the translation in the requested language, "
        "which perfectly preserves the meaning and stylistics and is overall a perfect and usable translation and "
        "text segment into English.",
        "Your task is to translate the following text; the language of this text is: ",
        "Now translate that text into English. Do not make any additional comments or explanations, do not comment "
        "on the task, do not repeat the input text -- only respond with the translation of the text."),
    "Russian": (
        "Ты — мощный ИИ-переводчик, лучшая модель для перевода с любого европейского языка на русский. Когда тебя "
        "просят перевести, ты отвечаешь переводом на требуемом языке, который идеально сохраняет смысл и стилистику "
        "и в целом является совершенным и пригодным переводом и текстовым фрагментом на русском.",
        "Твоя задача — перевести текст; язык этого текста",
        "Теперь переведи этот текст на русский. Не давай никаких дополнительных комментариев или объяснений, не "
        "комментируй задание, не повторяй входной текст — отвечай только переводом."),
    "Estonian": (
        "Sa oled võimas tehisintellektil põhinev tõlkija, parim mudel, mis suudab tõlkida kõigist Euroopa keeltest "
        "eesti keelde. Kui sinult palutakse tõlkida, vastad sa tõlkega soovitud keeles, mis säilitab täiuslikult "
        "tähenduse ja stiili ning on igati ideaalne ja kasutuskõlblik tõlge ja tekstilõik eesti keeles.",
        "Sinu ülesanne on tõlkida tekst; selle teksti keel on",
        "Nüüd tõlgi see tekst eesti keelde. Ära tee mingeid lisakommentaare ega selgitusi, ära kommenteeri ülesannet, "
        "ära korda sisendteksti — vasta ainult tõlkega."),
    "Latvian": (
        "Tu esi spēcīgs mākslīgā intelekta tulkotājs, labākais modelis, lai veiktu tulkojumus no jebkuras Eiropas "
        "valodas latviešu valodā. Kad no tevis tiek lūgts tulkot, tu atbildi ar tulkojumu pieprasītajā valodā, kas "
        "nevainojami saglabā nozīmi un stilistiku un kopumā ir perfekts un lietojams tulkojums un teksta fragments "
        "latviešu valodā.",
        "Tavs uzdevums ir iztulkot tekstu; šī teksta valoda ir",
        "Tagad iztulko šo tekstu latviešu valodā. Nesniedz nekādus papildu komentārus vai skaidrojumus, nekomentē "
        "uzdevumu, neatkārto ievades tekstu — atbildi tikai ar tulkojumu."),
    "Finnish": (
        "Olet tehokas tekoälykääntäjä, paras malli tuottamaan käännöksiä mistä tahansa eurooppalaisesta kielestä "
        "suomeen. Kun sinulta pyydetään käännöstä, vastaat pyydetyllä kielellä annetulla käännöksellä, joka "
        "säilyttää täydellisesti merkityksen ja tyylin ja on kokonaisuudessaan täydellinen ja käyttökelpoinen "
        "käännös ja tekstijakso suomeksi.",
        "Tehtäväsi on kääntää teksti; tämän tekstin kieli on",
        "Nyt käännä tuo teksti suomeksi. Älä tee mitään lisäkommentteja tai selityksiä, älä kommentoi tehtävää, älä "
        "toista syötetettyä tekstiä — vastaa vain käännöksellä."),
    "Hungarian": (
        "Te egy nagy teljesítményű mesterséges intelligencia fordító vagy, a legjobb modell bármely európai nyelvről "
        "magyarra történő fordításra. Amikor fordításra kérnek, a kért nyelven adod meg a fordítást, amely "
        "tökéletesen megőrzi a jelentést és a stílust, és összességében hibátlan, használható magyar nyelvű "
        "fordítás és szövegrész lesz.",
        "A feladatod egy szöveg lefordítása; ennek a szövegnek a nyelve",
        "Most fordítsd le ezt a szöveget magyarra. Ne fűzz semmilyen további megjegyzést vagy magyarázatot, ne "
        "kommentáld a feladatot, ne ismételd meg a bemeneti szöveget — csak a fordítással válaszolj."),
    "Swedish": (
        "Du är en kraftfull AI-översättare, den bästa modellen för att översätta från vilket europeiskt språk som "
        "helst till svenska. När du blir ombedd att översätta svarar du med översättningen på det begärda språket, "
        "som fullständigt bevarar betydelsen och stilen och som i sin helhet är en perfekt och användbar "
        "översättning och text på svenska.",
        "Din uppgift är att översätta en text; språket i denna text är",
        "Nu översätt den texten till svenska. Gör inga ytterligare kommentarer eller förklaringar, kommentera inte "
        "uppgiften, upprepa inte inmatningstexten — svara endast med översättningen."),
    "Norwegian": (
        "Du er en kraftig AI-oversetter, den beste modellen for å oversette fra ethvert europeisk språk til norsk. "
        "Når du blir bedt om å oversette, svarer du med oversettelsen på det ønskede språket, som perfekt bevarer "
        "meningen og stilen og som totalt sett er en fullkommen og brukbar oversettelse og tekstbit på norsk.",
        "Din oppgave er å oversette en tekst; språket i denne teksten er",
        "Oversett nå den teksten til norsk. Ikke kom med noen tilleggskommentarer eller forklaringer, ikke kommenter "
        "oppgaven, ikke gjenta inndatateksten — svar kun med oversettelsen."),
}
# ---------------------------------------------------------------------------

_FIELD = re.compile(r"\{([^{}]+)\}")


def _parts(template: str) -> list[tuple[bool, str]]:
    out, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            out.append((False, template[pos:m.start()]))
        out.append((True, m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append((False, template[pos:]))
    return out


def render(template: str, fields: dict[str, Column | str] | None = None) -> Column:
    """One ``concat`` of the template's literal parts and field columns.
    ``fields`` maps a placeholder to a Column or column name (default: the
    column of the same name)."""
    fields = fields or {}
    cols = []
    for is_field, s in _parts(template):
        if is_field:
            v = fields.get(s, s)
            c = F.col(f"`{v}`") if isinstance(v, str) else v
            cols.append(F.coalesce(c.cast("string"), F.lit("None")))
        else:
            cols.append(F.lit(s))
    return F.concat(*cols) if cols else F.lit("")


def sql_render(template: str, fields: dict[str, str] | None = None) -> str:
    fields = fields or {}
    out = []
    for is_field, s in _parts(template):
        if is_field:
            out.append(f"coalesce(CAST({fields.get(s, s)} AS VARCHAR), 'None')")
        else:
            out.append("'" + s.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")" if out else "''"


def _msg_map(i: int) -> Column:
    return F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v[i]))])


def messages_for(lang) -> tuple[Column, Column, Column]:
    """(system, text_is_in, postinstruction) for an output language; a
    language without messages fails the job at that row, like the reference's
    missing-key error."""
    c = F.col(lang) if isinstance(lang, str) else lang
    out = []
    for i in range(3):
        v = F.try_element_at(_msg_map(i), c)
        out.append(F.when(v.isNull(), F.raise_error(F.concat(F.lit("no prompt messages for language "),
                                                             F.coalesce(c, F.lit("NULL"))))).otherwise(v))
    return out[0], out[1], out[2]


# ---- prompt builders (B9-B15, B8, B21) ----

def prompt_mt_inference(lid: bool = False) -> Column:
    """LID or MT inference prompt."""
    return render(MT_LID_INFERENCE if lid else MT_INFERENCE)


def prompt_mt_train() -> Column:
    """Parallel template for translate/approx-translate with a non-empty
    target segment and target language, the monolingual one otherwise."""
    para = (F.col("task").isin("translate", "approx-translate") & (F.coalesce(F.col("tgt_segm"), F.lit("")) != "")
            & (F.coalesce(F.col("tgt_lang"), F.lit("")) != ""))
    return F.when(para, render(MT_TRAIN_PARA)).otherwise(render(MT_TRAIN_MONO))


def prompt_alpaca(inference: bool) -> Column:
    """B10."""
    return render(ALPACA_INFERENCE if inference else ALPACA_TRAIN)


def prompt_pivot(lang: str = "new_hi_res_lang") -> Column:
    """B13 (+D6): chat prompt with instructions in the output language."""
    system, text_is_in, post = messages_for(lang)
    user = render(PIVOT_USER_MESSAGE, {"text_is_in": text_is_in, "postinstruction": post})
    return render(CHAT_TEMPLATE, {"system_instruction": system, "user_instruction": user})


def prompt_qc_judge(hyp: str = "hyp-translation") -> Column:
    """yes/no translation judge prompt; the hypothesis column is a
    parameter (the reference reads a field the scorer never writes, Q7)."""
    user = render(QC_JUDGE_USER, {"hyp-translation": hyp})
    return render(CHAT_TEMPLATE, {"system_instruction": F.lit(QC_JUDGE_SYSTEM), "user_instruction": user})


def prompt_legacy(wording: str = "a") -> Column:
    """Legacy plain-text prompts in two wordings; wording 'b' leaves
    entries of other tasks as their source text."""
    para = F.col("task").isin("translate", "approx-translate")
    if wording == "a":
        return F.when(para, render(LEGACY_PARA_A)).otherwise(render(LEGACY_MONO_A))
    return (F.when(para, render(LEGACY_PARA_B)).when(F.col("task") == "generate", render(LEGACY_MONO_B))
            .otherwise(F.col("src_segm")))


def _split_variety(text: Column) -> tuple[Column, Column, Column]:
    """(has_tag, variety, text) of an input that may start with '<variety> '."""
    pos = F.instr(text, ">")
    tagged = text.startswith("<")
    n = F.char_length(text)
    variety = F.substring(text, F.lit(2), F.greatest(F.when(pos == 0, n - 2).otherwise(pos - 2), F.lit(0)))
    body = F.when(tagged, F.substring(text, pos + 2, F.lit(1 << 30))).otherwise(text)
    return tagged, variety, body


def prompt_gen_text(src_lang: str = "src_lang", tgt_lang: str = "tgt_lang", text: str = "src_segm",
                    output: str | None = None, eos: str | None = None) -> Column:
    """B8: 'Translate: == From ... == Output: ' prompt; a leading '<variety> '
    tag of the input becomes ', variety: <variety>'; with an output and an
    EOS string the training form appends both."""
    t = F.col(text)
    tagged, variety, body = _split_variety(t)
    var = F.when(tagged, F.concat(F.lit(GEN_TEXT_VARIETY), variety)).otherwise(F.lit(""))
    p = render(GEN_TEXT, {"src_lang": src_lang, "tgt_lang": tgt_lang, "variety": var, "text": body})
    if output is not None and eos is not None:
        p = F.when(F.col(output).isNull(), p).otherwise(F.concat(p, F.col(output), F.lit(eos)))
    return p


def strip_prompt_from_output(raw: str, prompt: str) -> Column:
    """Drop the prompt prefix by length, keep the first line."""
    r = F.col(raw)
    return F.substring_index(F.substring(r, F.char_length(F.col(prompt)) + 1, F.lit(1 << 30)), "\n", 1)


# ---- DuckDB text of the builders that are not a single template ----

def sql_messages_for(lang: str) -> tuple[str, str, str]:
    out = []
    for i in range(3):
        whens = " ".join("WHEN '" + k.replace("'", "''") + "' THEN '" + v[i].replace("'", "''") + "'"
                         for k, v in MESSAGES.items())
        out.append(f"(CASE {lang} {whens} ELSE error('no prompt messages for language ' || {lang}) END)")
    return out[0], out[1], out[2]


def sql_prompt_pivot(lang: str = "new_hi_res_lang") -> str:
    system, text_is_in, post = sql_messages_for(lang)
    user = sql_render(PIVOT_USER_MESSAGE, {"text_is_in": text_is_in, "postinstruction": post})
    return sql_render(CHAT_TEMPLATE, {"system_instruction": system, "user_instruction": user})


def sql_prompt_qc_judge(hyp: str) -> str:
    user = sql_render(QC_JUDGE_USER, {"hyp-translation": hyp})
    sys_sql = "'" + QC_JUDGE_SYSTEM.replace("'", "''") + "'"
    return sql_render(CHAT_TEMPLATE, {"system_instruction": sys_sql, "user_instruction": user})


def sql_prompt_mt_train() -> str:
    para = ("task IN ('translate', 'approx-translate') AND coalesce(tgt_segm, '') <> '' "
            "AND coalesce(tgt_lang, '') <> ''")
    return f"(CASE WHEN {para} THEN {sql_render(MT_TRAIN_PARA)} ELSE {sql_render(MT_TRAIN_MONO)} END)"


def sql_prompt_legacy(wording: str = "a") -> str:
    para = "task IN ('translate', 'approx-translate')"
    if wording == "a":
        return f"(CASE WHEN {para} THEN {sql_render(LEGACY_PARA_A)} ELSE {sql_render(LEGACY_MONO_A)} END)"
    return (f"(CASE WHEN {para} THEN {sql_render(LEGACY_PARA_B)} WHEN task = 'generate' THEN "
            f"{sql_render(LEGACY_MONO_B)} ELSE src_segm END)")


def sql_prompt_gen_text(src_lang: str, tgt_lang: str, text: str) -> str:
    pos = f"instr({text}, '>')"
    tagged = f"starts_with({text}, '<')"
    variety = f"substr({text}, 2, greatest(CASE WHEN {pos} = 0 THEN length({text}) - 2 ELSE {pos} - 2 END, 0))"
    body = f"(CASE WHEN {tagged} THEN substr({text}, {pos} + 2) ELSE {text} END)"
    var = f"(CASE WHEN {tagged} THEN '{GEN_TEXT_VARIETY}' || {variety} ELSE '' END)"
    return sql_render(GEN_TEXT, {"src_lang": src_lang, "tgt_lang": tgt_lang, "variety": var, "text": body})
