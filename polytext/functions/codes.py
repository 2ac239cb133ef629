"""Language-code conversion (D5), resource classes (E5), language-set aliases
(G2-G4) and the MADLAD target prefix (B16), as Column expressions over
literal maps (fixed, small) -- no join, no UDF.

The reference resolves two- and three-letter codes through an external ISO
639 package.  A code only changes under that lookup when it is a three-letter
code of a language that also has a two-letter code (or the reverse), so the
engine ships those pairs, all of ISO 639-1; a different table can be passed to
the builders as a dict.  Three-letter codes without a two-letter one stay as
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
# Uralic language sets (low / high) and their aliases.
SMUGRI_LOW = ("fkv,izh,kca,koi,kpv,krl,liv,lud,mdf,mhr,mns,mrj,myv,olo,sjd,sje,sju,sma,sme,smj,smn,sms,udm,vep,"
              "vot,vro")
SMUGRI_HIGH = "deu,eng,est,fin,hun,lvs,nor,rus,swe"
SMUGRI = SMUGRI_HIGH + "," + SMUGRI_LOW
ALIASES = [("smugri-low", SMUGRI_LOW), ("smugri-high", SMUGRI_HIGH), ("smugri", SMUGRI)]
CONTRACT_NAMES = [("smugri-low", SMUGRI_LOW), ("smugri-high", SMUGRI_HIGH), ("smugri-full", SMUGRI)]

# All NLLB codes (ISO 639-3 + script), in the published order; for an ISO code
# listed twice the later script wins.
NLLB_CODES = """
ace_Arab ace_Latn acm_Arab acq_Arab aeb_Arab afr_Latn ajp_Arab aka_Latn amh_Ethi apc_Arab arb_Arab ars_Arab
ary_Arab arz_Arab asm_Beng ast_Latn awa_Deva ayr_Latn azb_Arab azj_Latn bak_Cyrl bam_Latn ban_Latn bel_Cyrl
bem_Latn ben_Beng bho_Deva bjn_Arab bjn_Latn bod_Tibt bos_Latn bug_Latn bul_Cyrl cat_Latn ceb_Latn ces_Latn
cjk_Latn ckb_Arab crh_Latn cym_Latn dan_Latn deu_Latn dik_Latn dyu_Latn dzo_Tibt ell_Grek eng_Latn epo_Latn
est_Latn eus_Latn ewe_Latn fao_Latn pes_Arab fij_Latn fin_Latn fon_Latn fra_Latn fur_Latn fuv_Latn gla_Latn
gle_Latn glg_Latn grn_Latn guj_Gujr hat_Latn hau_Latn heb_Hebr hin_Deva hne_Deva hrv_Latn hun_Latn hye_Armn
ibo_Latn ilo_Latn ind_Latn isl_Latn ita_Latn jav_Latn jpn_Jpan kab_Latn kac_Latn kam_Latn kan_Knda kas_Arab
kas_Deva kat_Geor knc_Arab knc_Latn kaz_Cyrl kbp_Latn kea_Latn khm_Khmr kik_Latn kin_Latn kir_Cyrl kmb_Latn
kon_Latn kor_Hang kmr_Latn lao_Laoo lvs_Latn lij_Latn lim_Latn lin_Latn lit_Latn lmo_Latn ltg_Latn ltz_Latn
lua_Latn lug_Latn luo_Latn lus_Latn mag_Deva mai_Deva mal_Mlym mar_Deva min_Latn mkd_Cyrl plt_Latn mlt_Latn
mni_Beng khk_Cyrl mos_Latn mri_Latn zsm_Latn mya_Mymr nld_Latn nno_Latn nob_Latn npi_Deva nso_Latn nus_Latn
nya_Latn oci_Latn gaz_Latn ory_Orya pag_Latn pan_Guru pap_Latn pol_Latn por_Latn prs_Arab pbt_Arab quy_Latn
ron_Latn run_Latn rus_Cyrl sag_Latn san_Deva sat_Beng scn_Latn shn_Mymr sin_Sinh slk_Latn slv_Latn smo_Latn
sna_Latn snd_Arab som_Latn sot_Latn spa_Latn als_Latn srd_Latn srp_Cyrl ssw_Latn sun_Latn swe_Latn swh_Latn
szl_Latn tam_Taml tat_Cyrl tel_Telu tgk_Cyrl tgl_Latn tha_Thai tir_Ethi taq_Latn taq_Tfng tpi_Latn tsn_Latn
tso_Latn tuk_Latn tum_Latn tur_Latn twi_Latn tzm_Tfng uig_Arab ukr_Cyrl umb_Latn urd_Arab uzn_Latn vec_Latn
vie_Latn war_Latn wol_Latn xho_Latn ydd_Hebr yor_Latn yue_Hant zho_Hans zho_Hant zul_Latn
""".split()
# All MADLAD target tags, in the published order (fixed values).
MADLAD_CODES = """
<2meo> <2lo> <2Grek> <2ada> <2ps> <2arn> <2Armn> <2to> <2raj> <2bas> <2ny> <2> <2zza> <2Thai> <2kaa_Latn> <2yap>
<2en_xx_simple> <2ta> <2bg_Latn> <2mkn> <2lhu> <2gu_Latn> <2nzi> <2uz> <2pis> <2cfm> <2min> <2fon> <2tn> <2msi> <2sw>
<2Tfng> <2teo> <2taj> <2pap> <2sd> <2Jpan> <2tca> <2sr> <2an> <2fr> <2gor> <2az> <2qvi> <2pck> <2cak> <2ltg> <2sah>
<2tly_IR> <2ts> <2yo> <2hne> <2bzj> <2tuc> <2sh> <2da> <2gui> <2translate> <2et> <2sja> <2nhe> <2scn> <2dje> <2pt>
<2nog> <2fil> <2mai> <2lb> <2bm> <2Guru> <2gom> <2hr> <2kg> <2uk> <2rw> <2izz> <2Telu> <2wuu> <2Deva> <2or> <2is>
<2om> <2iso> <2sn> <2kjh> <2tbz> <2suz> <2bjn> <2lv> <2mfe> <2tcy> <2tyz> <2ksw> <2nds_NL> <2ms> <2mam> <2ubu> <2hil>
<2mh> <2gl> <2bew> <2ilo> <2kbd> <2toj> <2quf> <2jam> <2Beng> <2tyv> <2lmo> <2ace> <2cab> <2sq> <2ug> <2kac> <2ay>
<2mag> <2Arab> <2mrj> <2cs> <2bci> <2doi> <2zu> <2ndc_ZW> <2smt> <2ho> <2ss> <2he> <2twu> <2kjg> <2pag> <2Latn> <2gym>
<2sus> <2zh_Latn> <2mps> <2lg> <2ko> <2se> <2guc> <2mr> <2mwl> <2dwr> <2din> <2ffm> <2maz> <2nia> <2nl> <2Knda> <2jv>
<2noa> <2udm> <2kr> <2de> <2ar> <2ZW> <2dln> <2mn> <2ml> <2crh> <2ha> <2ks> <2qvc> <2fur> <2myv> <2nv> <2ak> <2Gujr>
<2cce> <2nso> <2sg> <2rmc> <2mas> <2mni> <2frp> <2my> <2xal> <2th> <2bik> <2bho> <2inb> <2Mlym> <2oj>
<2back_translated> <2tet> <2gsw> <2ff> <2hy> <2otq> <2el> <2agr> <2br> <2alt> <2tzo> <2chm> <2transliterate> <2hu>
<2btx> <2vi> <2iba> <2bg> <2gub> <2li> <2ace_Arab> <2qub> <2ktu> <2bru> <2bbc> <2ca> <2hvn> <2sat_Latn> <2ku> <2shn>
<2djk> <2krc> <2io> <2ig> <2chk> <2sm> <2Mymr> <2Kore> <2ary> <2lu> <2fa> <2spp> <2af> <2ti> <2Tibt> <2emp> <2enq>
<2kl> <2be> <2srn> <2ms_Arab_BN> <2kri> <2gd> <2mk> <2syr> <2kmz_Latn> <2CA> <2ium> <2abt> <2ngu> <2tab> <2it> <2ru>
<2ann> <2msm> <2fo> <2ne> <2akb> <2kv> <2jac> <2ceb> <2ang> <2tdx> <2tr> <2kbp> <2mgh> <2az_RU> <2acf> <2tg> <2dov>
<2pau> <2mg> <2fuv> <2nn> <2Hant> <2hui> <2ml_Latn> <2ja> <2lus> <2te> <2qu> <2rom> <2tsg> <2el_Latn> <2cr_Latn> <2ur>
<2fi> <2shp> <2brx> <2laj> <2sda> <2lij> <2st> <2bn> <2zxx_xx_dtynoise> <2yua> <2no> <2fr_CA> <2miq> <2trp> <2es>
<2ch> <2mass> <2os> <2bts> <2ady> <2lrc> <2seh> <2adh> <2new> <2mak> <2grc> <2nus> <2tzj> <2nut> <2gu> <2oc> <2ppk>
<2Hans> <2tzh> <2si> <2wo> <2nyu> <2Hebr> <2mad> <2tll> <2kr_Arab> <2pon> <2mbt> <2kw> <2bjn_Arab> <2gn> <2eu> <2dz>
<2kaa> <2crh_Latn> <2te_Latn> <2ky> <2kn_Latn> <2kum> <2fip> <2ksd> <2sk> <2NL> <2ctd_Latn> <2Khmr> <2gbm> <2Cans>
<2haw> <2gag> <2Taml> <2cnh> <2bim> <2ms_Arab> <2Thaa> <2kha> <2tvl> <2Cyrl> <2chr> <2dtp> <2ba> <2nan_Latn_TW> <2ro>
<2ctu> <2Ethi> <2zh> <2ln> <2ve> <2xh> <2skr> <2ber> <2niq> <2ibb> <2jvn> <2tks> <2av> <2ahk> <2tk> <2tt> <2ka> <2tsc>
<2km> <2co> <2id> <2prs> <2rki> <2kmb> <2ks_Deva> <2ify> <2wal> <2arz> <2amu> <2rm> <2pa> <2RU> <2ce> <2hi> <2eo>
<2taq> <2ga> <2qxr> <2la> <2bi> <2rwo> <2dyu> <2zh_Hant> <2mt> <2bqc> <2bn_Latn> <2zne> <2szl> <2lt> <2sl> <2hif>
<2alz> <2ber_Latn> <2ckb> <2wa> <2Cher> <2msb> <2gom_Latn> <2ru_Latn> <2crs> <2kk> <2gvl> <2qvz> <2bar> <2qup> <2bgp>
<2bo> <2su> <2tzm> <2IR> <2sv> <2srm> <2rn> <2bus> <2jiv> <2awa> <2gv> <2knj> <2as> <2quc> <2en> <2sa> <2bug> <2quy>
<2hi_Latn> <2nds> <2kek> <2mrw> <2kos> <2cy> <2ta_Latn> <2kn> <2nr> <2ape> <2bs> <2iu> <2nnb> <2Geor> <2rcf> <2meu>
<2cac> <2cuk> <2bua> <2vec> <2so> <2fj> <2gof> <2koi> <2cv> <2guh> <2war> <2pl> <2cbk> <2kj> <2dv> <2mdf> <2fy> <2am>
<2sc> <2taq_Tfng> <2mi> <2zap> <2mqy> <2yi> <2kwi> <2hmn> <2tiv> <2sxn> <2hus> <2ban> <2nij> <2tlh> <2Orya> <2quh>
<2ee> <2ht> <2bum> <2stq>
""".split()
# Overrides and the extra Uralic languages by script.
NLLB_OVERRIDES = [("lav", "lvs_Latn"), ("nor", "nob_Latn"), ("yid", "ydd_Hebr")]
EXTRA_LATN = "fkv izh krl liv lud olo sje sju sma sme smj smn sms vep vot vro".split()
EXTRA_CYRL = "kca koi kpv mdf mhr mns mrj myv sjd udm".split()
UNKNOWN_SCRIPT = "Unk"
# ISO 639-1 two-letter code:ISO 639-3 code, all of the standard.
ISO_PAIRS = [tuple(p.split(":")) for p in """
aa:aar ab:abk ae:ave af:afr ak:aka am:amh an:arg ar:ara as:asm av:ava ay:aym az:aze ba:bak be:bel bg:bul bi:bis
bm:bam bn:ben bo:bod br:bre bs:bos ca:cat ce:che ch:cha co:cos cr:cre cs:ces cu:chu cv:chv cy:cym da:dan de:deu
dv:div dz:dzo ee:ewe el:ell en:eng eo:epo es:spa et:est eu:eus fa:fas ff:ful fi:fin fj:fij fo:fao fr:fra fy:fry
ga:gle gd:gla gl:glg gn:grn gu:guj gv:glv ha:hau he:heb hi:hin ho:hmo hr:hrv ht:hat hu:hun hy:hye hz:her ia:ina
id:ind ie:ile ig:ibo ii:iii ik:ipk io:ido is:isl it:ita iu:iku ja:jpn jv:jav ka:kat kg:kon ki:kik kj:kua kk:kaz
kl:kal km:khm kn:kan ko:kor kr:kau ks:kas ku:kur kv:kom kw:cor ky:kir la:lat lb:ltz lg:lug li:lim ln:lin lo:lao
lt:lit lu:lub lv:lav mg:mlg mh:mah mi:mri mk:mkd ml:mal mn:mon mr:mar ms:msa mt:mlt my:mya na:nau nb:nob nd:nde
ne:nep ng:ndo nl:nld nn:nno no:nor nr:nbl nv:nav ny:nya oc:oci oj:oji om:orm or:ori os:oss pa:pan pi:pli pl:pol
ps:pus pt:por qu:que rm:roh rn:run ro:ron ru:rus rw:kin sa:san sc:srd sd:snd se:sme sg:sag sh:hbs si:sin sk:slk
sl:slv sm:smo sn:sna so:som sq:sqi sr:srp ss:ssw st:sot su:sun sv:swe sw:swa ta:tam te:tel tg:tgk th:tha ti:tir
tk:tuk tl:tgl tn:tsn to:ton tr:tur ts:tso tt:tat tw:twi ty:tah ug:uig uk:ukr ur:urd uz:uzb ve:ven vi:vie vo:vol
wa:wln wo:wol xh:xho yi:yid yo:yor za:zha zh:zho zu:zul
""".split()]
# Resource classes by ISO 639-3 code.
CLASS_0 = "krl,sma,vep,smj,smn,lud,liv,izh,vot,kca,sms,sje,mns,fkv,sju,sjd".split(",")
CLASS_1 = "kpv,sme,mhr,udm,olo,myv,mdf,vro,mrj,koi".split(",")
CLASS_2PLUS = SMUGRI_HIGH.split(",")
# ---------------------------------------------------------------------------


def iso3_to_nllb() -> dict[str, str]:
    out: dict[str, str] = {}
    for code in NLLB_CODES:
        iso, script = code.split("_")
        out[iso] = f"{iso}_{script}"          # later entries win
    out.update(dict(NLLB_OVERRIDES))
    out.update({c: f"{c}_Latn" for c in EXTRA_LATN})
    out.update({c: f"{c}_Cyrl" for c in EXTRA_CYRL})
    return out


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_code(raw) -> Column:
    """'<2xx>' -> 'xx'; 'xxx_Scrp' -> 'xxx'."""
    r = _c(raw)
    inner = F.when(r.contains("<2"), F.substring(r, F.lit(3), F.greatest(F.char_length(r) - 3, F.lit(0)))) \
        .otherwise(r)
    return F.substring_index(inner, "_", 1)


def base_code(raw, iso_pairs: dict[str, str] | None = None) -> Column:
    """ISO 639-3 code of any code style (two-letter codes via the ISO table);
    unknown codes are kept as cleaned."""
    pairs = iso_pairs or dict(ISO_PAIRS)
    c = clean_code(raw)
    return F.coalesce(F.try_element_at(_map(pairs), c), c)


def to_nllb(raw, iso_pairs: dict[str, str] | None = None) -> Column:
    """NLLB code ('eng_Latn'); unknown script -> '<code>_Unk'."""
    b = base_code(raw, iso_pairs)
    return F.coalesce(F.try_element_at(_map(iso3_to_nllb()), b), F.concat(b, F.lit("_" + UNKNOWN_SCRIPT)))


def to_madlad(raw, iso_pairs: dict[str, str] | None = None) -> Column:
    """MADLAD target tag ('<2en>'), two-letter code preferred."""
    pairs = iso_pairs or dict(ISO_PAIRS)
    b = base_code(raw, pairs)
    inv = {v: k for k, v in pairs.items()}
    return F.concat(F.lit("<2"), F.coalesce(F.try_element_at(_map(inv), b), b), F.lit(">"))


def resource_class(raw) -> Column:
    """E5: '0', '1', '2+' by ISO 639-3 code, '?' otherwise."""
    b = base_code(raw)
    return (F.when(b.isin(CLASS_0), "0").when(b.isin(CLASS_1), "1").when(b.isin(CLASS_2PLUS), "2+")
            .otherwise("?"))


def expand_lang_set(lang_def) -> Column:
    """Alias -> its language set, otherwise split on commas (distinct)."""
    d = _c(lang_def)
    txt = d
    for name, val in reversed(ALIASES):
        txt = F.when(d == name, F.lit(val)).otherwise(txt)
    return F.array_distinct(F.split(txt, ",", -1))


def contract_lang_set(langs) -> Column:
    """Sorted set -> alias when it equals a known set (compared as sets,
    so the full alias is reachable), else the sorted, comma-joined codes."""
    s = F.array_sort(F.array_distinct(_c(langs)))
    out = F.array_join(s, ",")
    for name, val in reversed(CONTRACT_NAMES):
        target = sorted(set(val.split(",")))
        out = F.when(F.array_join(s, ",") == ",".join(target), F.lit(name)).otherwise(out)
    return out


def madlad_prefix(text, lang) -> Column:
    """MADLAD input '<2xx> text'."""
    return F.concat(to_madlad(lang), F.lit(" "), _c(text))


# ---- DuckDB text of the same builders ----

def _sql_case_map(e: str, d: dict[str, str]) -> str:
    def lst(xs):
        return "[" + ", ".join(f"'{x}'" for x in xs) + "]"

    return f"list_extract({lst(d.values())}, list_position({lst(d)}, {e}))"


def sql_clean_code(e: str) -> str:
    inner = f"(CASE WHEN contains({e}, '<2') THEN substr({e}, 3, greatest(length({e}) - 3, 0)) ELSE {e} END)"
    return f"split_part({inner}, '_', 1)"


def sql_base_code(e: str) -> str:
    c = sql_clean_code(e)
    return f"coalesce({_sql_case_map(c, dict(ISO_PAIRS))}, {c})"


def sql_to_nllb(e: str) -> str:
    b = sql_base_code(e)
    return f"coalesce({_sql_case_map(b, iso3_to_nllb())}, {b} || '_{UNKNOWN_SCRIPT}')"


def sql_to_madlad(e: str) -> str:
    b = sql_base_code(e)
    inv = {v: k for k, v in ISO_PAIRS}
    return f"('<2' || coalesce({_sql_case_map(b, inv)}, {b}) || '>')"


def sql_resource_class(e: str) -> str:
    b = sql_base_code(e)

    def lst(xs):
        return "(" + ", ".join(f"'{x}'" for x in xs) + ")"

    return (f"(CASE WHEN {b} IN {lst(CLASS_0)} THEN '0' WHEN {b} IN {lst(CLASS_1)} THEN '1' "
            f"WHEN {b} IN {lst(CLASS_2PLUS)} THEN '2+' ELSE '?' END)")


def list_coverage(codes: DataFrame) -> DataFrame:
    """(direction, good, fail, err) of the codes of each source (``src``,
    ``raw_code``), converted to both models' codes: converted codes that the
    target's published list holds, and those it lacks.  Conversions never raise."""
    targets = (("nllb", to_nllb, NLLB_CODES), ("madlad", to_madlad, MADLAD_CODES))
    rows = codes.select("src", F.inline(F.array(*[
        F.struct(F.lit(t).alias("tgt"), conv("raw_code").isin(known).alias("ok")) for t, conv, known in targets])))
    return rows.groupBy(F.concat_ws("_to_", "src", "tgt").alias("direction")).agg(
        F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("fail"), F.lit(0).cast("bigint").alias("err"))
