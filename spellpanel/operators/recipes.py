"""The 31 high-volume pathways and their seven specialties, as rule data."""

from __future__ import annotations

from spellpanel.operators.rules import (
    Recipe,
    diag,
    main_in,
    main_is,
    primary,
    primary_diag,
    primary_is,
    primary_like,
    proc,
    treated_in,
)

SPECIALTIES = ["ort", "opht", "gs", "uro", "ent", "gm", "spn"]
SPECIALTY_NAMES = {
    "ort": "Orthopaedics",
    "opht": "Ophthalmology",
    "gs": "General Surgery",
    "uro": "Urology",
    "ent": "ENT",
    "gm": "Gynaecology and Maternity",
    "spn": "Spinal",
}

# Clinical codes of the published recipes.
REVISION = "Y713 Y716 Y717"
KNEE_SITES = "Z845 Z846"
SHOULDER_SITES = "Z812 Z813 Z814 Z891"
EYE_EXCLUDED_PROCS = (
    "C647 C776 C792 C793 C795 C796 C797 C801 C802 C803 C804 C805 C806 C808 C809"
)
EYE_EXCLUDED_DIAGS = (
    "F00 F01 F02 F03 G30 F051 G310 G311 F70 F71 F72 F73 F78 F79 H200 H201 H202 H208 H209 "
    "H220 H221 H300 H301 H302 H308 H309 H320"
)
HEAD_NECK_CANCER = (
    "C01 C051 C052 C07 C080 C081 C089 C090 C091 C098 C099 C100 C101 C102 C103 C108 C109 "
    "C110 C111 C112 C113 C118 C119 C12 C130 C131 132 C138 C139 C320 C321 C322 C328 C329 C73"
)
HEAD_NECK_CANCER_CORRECTED = HEAD_NECK_CANCER.replace(" 132 ", " C132 ")
GYNAE_CANCER = "C51 C52 C53 C54 C55 C56 C57 C796 D06 D070 D071 D072 D073"
LUMBAR_DECOMPRESSION = (
    "V252 V254 V255 V256 V258 V259 V671 V672 V331 V332 V337 V338 V339"
)
LUMBAR_EXPLORATION = "V351 V358 V359"
LUMBAR_SITES = "Z063 Z073 Z665 Z675 Z676 Z993"
LUMBAR_REVISION = (
    "V262 V264 V265 V266 V268 V269 V681 V682 V688 V689 V341 V342 V347 V348 V349 V553"
)
LUMBAR_FUSION = "V251 V253 V382 V383 V384 V385 V386 V404"
FUSION_REVISION = (
    "V261 V263 V267 V343 V344 V345 V346 V393 V394 V395 V396 V397 V262 V264 V265 V266 V268 "
    "V269 V681 V682 V688 V689 V553"
)
CERVICAL_EXCLUDED = (
    "V224 V225 V226 V231 V232 V233 V234 V235 V236 V237 V238 V239 V301 V302 V303 V304 V305 "
    "V306 V308 V309 V371 V373 V374 V375 V376 V377 V391 V553 V41 V42"
)

UROLOGY = main_is("101") | treated_in("101 211")
ENT = main_is("120") | treated_in("120 215")
GYNAECOLOGY = main_in("500 502") | treated_in("502 503")


def build_recipes(corrected: bool = False) -> list[Recipe]:
    """All pathway recipes.

    ``corrected`` searches the head-and-neck cancer exclusion of the ENT
    pathways among diagnoses with its full code; by default it is kept as
    published (among procedures, one code without its letter).
    """
    head_neck = diag(HEAD_NECK_CANCER_CORRECTED) if corrected else proc(HEAD_NECK_CANCER)
    no_gynae_cancer = ~diag(GYNAE_CANCER)
    decompression = proc(LUMBAR_DECOMPRESSION)
    exploration = proc(LUMBAR_EXPLORATION) & proc(LUMBAR_SITES)

    def recipe(name: str, rule) -> Recipe:
        specialty, pathway = name.split("_")
        return Recipe(specialty, pathway, rule)

    return [
        # orthopaedics
        recipe("ort_aclr", primary("W723 W742 W752 W748 W758 W841 W842") & proc(KNEE_SITES)),
        recipe(
            "ort_thr",
            (
                primary("W371 W379 W381 W389 W931 W939 W391 W399 W941 W949 W951 W959")
                | (primary("W521 W529 W531 W539 W541 W549") & proc("Z843"))
            )
            & ~proc("W05 " + REVISION)
            & ~diag("C402"),
        ),
        recipe(
            "ort_tkr",
            primary("O181 O189 W401 W409 W411 W419 W421 W429 O188 W408 W418 W428")
            & ~proc(REVISION + " W05 Y031-Y039")
            & ~diag("M932 M939 Q774")
            & ~primary_diag("C400 C401 C402 C403 C408 C409 C492"),
        ),
        recipe("ort_ukr", primary_is("W581") & proc(KNEE_SITES + " Z132")),
        recipe("ort_bs", proc("W791 W792 W151 W152 W153")),
        recipe(
            "ort_tsa",
            (primary("W781 T791 O291 T794") & proc("Y767"))
            | (primary_is("W844") & proc("Z682 " + SHOULDER_SITES))
            | (primary("T645 T702") & proc("Z544") & proc("Y767"))
            | (
                primary_is("W784")
                & proc(SHOULDER_SITES + " Z681 Z682 Z683 Z684 Z685 Z688 Z689 Z691 Z693")
            ),
        ),
        # ophthalmology
        recipe(
            "opht_lccs",
            proc("C71 C73 C74") & proc("C751 C754 C758 C759") & ~proc(EYE_EXCLUDED_PROCS) & ~diag(EYE_EXCLUDED_DIAGS),
        ),
        # general surgery
        recipe("gs_lc", primary("J181 J183") & proc("Y752") & ~proc("J182")),
        recipe("gs_pihr", proc("T201 T202 T203 T204 T208 T209") & ~proc(REVISION) & ~diag("C56 C570")),
        recipe("gs_puh", primary("T240-T243 T245-T249") & ~primary_is("T244")),
        # urology
        recipe("uro_boo", UROLOGY & primary("M651 M653-M656 M658-M659 M662 M681 M683 M688-M689")),
        recipe("uro_btr", UROLOGY & primary_is("M421")),
        recipe("uro_cp", UROLOGY & primary("M451-M455 M458-M459 M441-M442 M763-M764 M792 M814")),
        recipe(
            "uro_usm",
            UROLOGY
            & primary("M071-M072 M078-M079 M271-M275 M277-M279 M306 M281-M283 M288-M289 M292-M293 M295"),
        ),
        recipe(
            "uro_mpss",
            UROLOGY
            & primary(
                "N303 N284 N111-N116 N118-N119 N132 N321 N081-N084 N088-N089 N091-N094 N098-N099 "
                "N191 N198-N199 M731 T193"
            ),
        ),
        # ear, nose and throat
        recipe(
            "ent_ess",
            ENT & primary("E132-E133 E142-E143 E081 E148") & proc("Y761") & ~head_neck,
        ),
        recipe("ent_tons", ENT & primary("F341-F345 F347-F349") & ~proc("D345 F346") & ~head_neck),
        recipe("ent_mir", ENT & primary("D141-D142 D148-D149") & ~head_neck),
        recipe("ent_sts", ENT & primary("E036 E041-E049") & ~head_neck),
        recipe("ent_srp", ENT & primary("E023-E024 E073") & ~head_neck),
        # gynaecology and maternity
        recipe(
            "gm_ol",
            GYNAECOLOGY
            & (
                primary("Q201 Q362 Q381-Q382 Q388-Q389 Q413 Q521-Q522")
                | primary_like("^Q39|Q49|Q50|T42")
            )
            & ~proc("Q383")
            & no_gynae_cancer,
        ),
        recipe("gm_lh", GYNAECOLOGY & proc("Q07 Q08") & proc("Y751 Y752") & no_gynae_cancer),
        recipe("gm_ea", GYNAECOLOGY & proc("Q162 Q163 Q164 Q165 Q166 Q176 Q177") & no_gynae_cancer),
        recipe(
            "gm_hs",
            GYNAECOLOGY
            & (primary("Q161 Q167-Q169 Q171-Q175 Q178-Q179") | primary_like("^Q18"))
            & ~proc("Y751 Y752 Y755 Q413")
            & no_gynae_cancer,
        ),
        recipe("gm_vh", GYNAECOLOGY & proc("Q08 P22 P23 P24") & no_gynae_cancer),
        # spinal; AND binds before OR in the two rules without brackets
        recipe("spn_ld", (decompression | exploration) & ~proc(LUMBAR_REVISION) & ~proc(LUMBAR_FUSION)),
        recipe("spn_pfs1", decompression | (exploration & ~proc(LUMBAR_REVISION) & proc(LUMBAR_FUSION))),
        recipe(
            "spn_csd",
            (proc("V221 V222 V294 V295 V361") | (proc("V368 V369") & proc("Z673 Z991")))
            & ~proc(CERVICAL_EXCLUDED),
        ),
        recipe("spn_lmbb", primary_is("V544")),
        recipe("spn_lnrb", primary("A521-A522 A528-A529 A577") | (primary_is("A735") & proc("Z07"))),
        recipe("spn_pfs2", proc(LUMBAR_FUSION) & ~proc(FUSION_REVISION)),
    ]


RECIPES = build_recipes()
