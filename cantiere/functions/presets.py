"""Procurement preset: rule tables, weights and thresholds.

FIXED VALUES.  Everything in this module is data that decides results (word
lists, labels, thresholds, points).  Operators take them as parameters.
"""

from __future__ import annotations

# -- sentinels ---------------------------------------------------------------

UNASSIGNED = "NON ASSEGNATA"
AMBIGUOUS = "AMBIGUA"
OTHER = "Altro"

MISSING_TOKENS = ("DATO NON PRESENTE", "NON PRESENTE", "N.D.", "ND", "NO", "N", "***************", "********", "-")

NOT_A_STATUS = ("ITALIA", "CENTRO", "NORD", "SUD", "ISOLE")
STATUS_WORDS = ("ATTIVO", "CHIUSO", "REVOCATO", "CANCELLATO", "ANNULLATO")
DEAD_STATUS_WORDS = ("CHIUSO", "REVOCATO", "CANCELLATO", "ANNULLATO")

FUNDING_WORDS = ("STATALE", "REGIONALE", "COMUNALE", "PROVINCIALE", "COMUNITARIA", "PRIVATA", "ALTRA PUBBLICA")

GENERIC_PLACES = ("TUTTI", "TUTTE", "VARI", "DIVERSI")
INVALID_PLACES = ("", "TUTTI", "TUTTE", "VARI", "VARIE", "NAZIONALE", "ITALIA")

# -- glyph repair ------------------------------------------------------------

GLYPH_REPAIRS = (
    ("Ã¨", "è"), ("Ã©", "é"), ("Ã\u00a0", "à"), ("Ã ", "à"), ("Ã²", "ò"), ("Ã¹", "ù"), ("Ã¬", "ì"),
    ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "-"),
    ("\u0091", "'"), ("\u0092", "'"), ("\u0093", '"'), ("\u0094", '"'), ("\u0096", "-"), ("\u0097", "-"),
    ("\u00a0", " "), ("\u00bf", "'"), ("\ufffd", "'"), ("\ufeff", ""),
)

# -- first-match taxonomies --------------------------------------------------

CATEGORIES = {
    "Scuole / formazione": [
        "scuola", "scolastico", "asilo", "nido", "infanzia", "primaria", "secondaria", "formazione",
        "polo scolastico", "mensa scolastica",
    ],
    "Sport / impianti sportivi": [
        "palestra", "palazzetto", "campo sportivo", "impianto sportivo", "piscina", "spogliatoi",
        "centro sportivo", "stadio",
    ],
    "Sanità / RSA": [
        "rsa", "casa di riposo", "residenza sanitaria", "centro anziani", "ospedale", "poliambulatorio",
        "distretto sanitario", "sanitario",
    ],
    "Cultura / centri civici": [
        "biblioteca", "teatro", "auditorium", "centro culturale", "centro civico", "museo",
        "sala polivalente", "polo culturale",
    ],
    "Riqualificazione urbana": [
        "riqualificazione", "rigenerazione urbana", "arredo urbano", "parco", "piazza", "verde pubblico",
        "area dismessa", "recupero area",
    ],
    "Edilizia pubblica": [
        "edificio pubblico", "municipio", "sede comunale", "uffici pubblici", "fabbricato",
        "immobile comunale", "edificio polifunzionale",
    ],
    "Infrastrutture / parcheggi": [
        "parcheggio", "strada", "viabilità", "marciapiede", "ponte", "rotatoria", "urbanizzazione",
        "pista ciclabile",
    ],
    "Ambiente / rifiuti / depurazione": [
        "rifiuti", "depuratore", "depurazione", "fognatura", "acquedotto", "bonifica", "discarica",
        "trattamento rifiuti",
    ],
    "Industriale / logistica": [
        "magazzino", "logistica", "capannone", "area produttiva", "zona industriale", "polo produttivo",
    ],
    "Energia": ["fotovoltaico", "agrivoltaico", "eolico", "energia", "bess", "accumulo", "biometano"],
    "Residenziale pubblico / ERS": [
        "edilizia residenziale", "alloggi", "ers", "housing", "case popolari", "social housing",
    ],
}

NATIONAL_CATEGORIES = {
    "Scuole / formazione": [
        "scuola", "scolastico", "asilo", "nido", "infanzia", "primaria", "secondaria", "formazione",
        "polo scolastico", "mensa scolastica",
    ],
    "Sport / impianti sportivi": [
        "palestra", "palazzetto", "campo sportivo", "impianto sportivo", "piscina", "spogliatoi",
        "centro sportivo", "stadio",
    ],
    "Sanità / RSA": [
        "rsa", "casa di riposo", "residenza sanitaria", "centro anziani", "ospedale", "poliambulatorio",
        "distretto sanitario", "sanitario", "casa della comunita", "casa della comunità",
    ],
    "Cultura / centri civici": [
        "biblioteca", "teatro", "auditorium", "centro culturale", "centro civico", "museo",
        "sala polivalente", "polo culturale", "cinema",
    ],
    "Riqualificazione urbana": [
        "riqualificazione", "rigenerazione urbana", "arredo urbano", "parco", "piazza", "verde pubblico",
        "area dismessa", "recupero area", "giardini pubblici",
    ],
    "Edilizia pubblica": [
        "edificio pubblico", "municipio", "sede comunale", "uffici pubblici", "fabbricato",
        "immobile comunale", "edificio polifunzionale", "patrimonio comunale",
    ],
    "Infrastrutture / parcheggi": [
        "parcheggio", "strada", "viabilità", "marciapiede", "ponte", "rotatoria", "urbanizzazione",
        "pista ciclabile", "viabilita", "pavimentazione stradale", "illuminazione pubblica",
    ],
    "Ambiente / rifiuti / depurazione": [
        "rifiuti", "depuratore", "depurazione", "fognatura", "acquedotto", "bonifica", "discarica",
        "trattamento rifiuti", "acque reflue", "risorse idriche",
    ],
    "Industriale / logistica": [
        "magazzino", "logistica", "capannone", "area produttiva", "zona industriale", "polo produttivo",
        "stoccaggio materiali",
    ],
    "Energia": [
        "fotovoltaico", "agrivoltaico", "eolico", "energia", "bess", "accumulo", "biometano",
        "efficientamento energetico",
    ],
    "Residenziale pubblico / ERS": ["edilizia residenziale", "alloggi", "ers", "housing", "case popolari", "social housing"],
}

# Categories worth points in the commercial scores: all but energy and the fallback.
HIGH_CATEGORIES = (
    "Scuole / formazione", "Sport / impianti sportivi", "Sanità / RSA", "Cultura / centri civici",
    "Riqualificazione urbana", "Edilizia pubblica", "Infrastrutture / parcheggi",
    "Ambiente / rifiuti / depurazione", "Industriale / logistica", "Residenziale pubblico / ERS",
)

INTERVENTION_TYPES = {
    "nuova costruzione": ["nuova realizzazione", "nuova costruzione", "realizzazione", "costruzione"],
    "ristrutturazione": ["ristrutturazione"],
    "riqualificazione": ["riqualificazione"],
    "manutenzione straordinaria": ["manutenzione straordinaria"],
    "messa in sicurezza": ["messa in sicurezza"],
    "efficientamento energetico": ["efficientamento"],
}

PHASES = {
    "programmazione / progetto attivo": ["ATTIVO"],
    "chiuso": ["CHIUSO"],
    "revocato / cancellato": ["REVOCATO", "CANCELLATO"],
}
DEFAULT_PHASE = "programmazione"
GOOD_PHASES = ("programmazione", "progetto attivo", "progettazione", "gara", "appalto", "affidamento")

# -- noise and candidate filters ---------------------------------------------

NON_CONSTRUCTION_NOISE = [
    "premio assicurativo", "premi assicurativi", "raccolto", "animali", "sottomisura 17.1",
    "agevolazioni fiscali", "indennità compensative", "indennita compensative", "compensazioni",
    "sostegno al reddito", "acquisto servizi reali", "attivita' di ricerca", "attività di ricerca",
    "progetti di ricerca", "ricerca sviluppo tecnologico", "nuova gamma di elettrodomestici",
    "spese materiale", "agevolazione fiscale", "contributive",
]
NATIONAL_NOISE = [
    "premio assicurativo", "premi assicurativi", "raccolto", "animali", "sottomisura 17.1",
    "agevolazioni fiscali", "indennità compensative", "indennita compensative", "compensazioni",
    "sostegno al reddito", "acquisto servizi reali", "attivita' di ricerca", "attività di ricerca",
    "progetti di ricerca", "ricerca sviluppo tecnologico", "nuova gamma di elettrodomestici",
    "spese materiale", "agevolazione fiscale", "contributive", "voucher", "corso di formazione",
    "servizio civile",
]
LIGHT_PROJECT_NOISE = [
    "premio assicurativo", "premi assicurativi", "raccolto", "animali", "sottomisura 17.1",
    "agevolazioni fiscali", "indennità compensative", "indennita compensative", "compensazioni",
    "sostegno al reddito", "acquisto servizi reali", "attivita' di ricerca", "attività di ricerca",
    "progetti di ricerca", "ricerca sviluppo tecnologico", "nuova gamma di elettrodomestici",
    "spese materiale", "acquisto arredi", "acquisto attrezzature", "fornitura libri", "contributo",
    "contributi", "agevolazione", "agevolazioni", "voucher", "corso di formazione", "servizio civile",
]

NATIONAL_CANDIDATES = [
    "lavori pubblici", "realizzazione di lavori pubblici", "opere ed impiantistica", "nuova realizzazione",
    "manutenzione straordinaria", "ristrutturazione", "riqualificazione", "messa in sicurezza",
    "adeguamento sismico", "efficientamento energetico", "infrastrutture sociali",
    "infrastrutture ambientali", "infrastrutture di trasporto", "immobili", "ambiente ed energia", "trasporti",
]
GENERIC_WORK_WORDS = [
    "lavori", "realizzazione", "costruzione", "ristrutturazione", "manutenzione straordinaria",
    "messa in sicurezza", "adeguamento sismico", "efficientamento energetico",
]

# -- segments ----------------------------------------------------------------

SEGMENT_WEIGHTS = {
    "Edilizia": 30, "Completamento e finitura edifici": 25, "Impiantisti sottoservizi": 25,
    "Lavori pubblici strade": 24, "Industria": 18, "Demolizioni": 16, "Verde": 12,
    "Agricoltura / silvicoltura": 10, "Impiantisti": 10, "Bonifiche e gestione rifiuti": 8,
    "Servizi": 5, "Commercio": 3, "Trasporto": 3, "Altro": -10,
}

SEGMENT_TERMS = {
    "Demolizioni": ["demolizione", "demolizioni", "demolire", "abbattimento", "rimozione fabbricato"],
    "Impiantisti sottoservizi": [
        "fognatura", "fognario", "acquedotto", "rete idrica", "reti idriche", "acque reflue", "depurazione",
        "depuratore", "sottoservizi", "cavidotto", "cavidotti", "condotta", "collettore", "scarico",
    ],
    "Lavori pubblici strade": [
        "strada", "strade", "viabilita", "viabilità", "pavimentazione stradale", "rotatoria", "marciapiede",
        "ponte", "pista ciclabile", "ciclabile", "illuminazione pubblica", "banchina stradale",
        "messa in sicurezza viaria",
    ],
    "Verde": [
        "verde", "parco", "giardino", "giardini", "alberature", "forestale", "arredo urbano", "area verde",
        "verde pubblico", "rinaturalizzazione",
    ],
    "Bonifiche e gestione rifiuti": [
        "bonifica", "bonifiche", "rifiuti", "discarica", "trattamento rifiuti", "amianto", "inquinamento",
        "messa in sicurezza permanente",
    ],
    "Industria": [
        "capannone", "magazzino", "logistica", "polo logistico", "area produttiva", "zona industriale",
        "stabilimento", "opificio", "impianto produttivo", "stoccaggio materiali",
    ],
    "Impiantisti": [
        "impianto elettrico", "impianti elettrici", "impianto termico", "impianti termici", "climatizzazione",
        "riscaldamento", "fotovoltaico", "efficientamento energetico", "centrale termica", "illuminazione",
        "antincendio", "impiantistico", "adeguamento impiantistico",
    ],
    "Completamento e finitura edifici": [
        "copertura", "manto di copertura", "tetto", "infissi", "serramenti", "facciata", "facciate",
        "rivestimenti", "finiture", "pavimentazione interna", "cartongesso", "intonaco", "tinteggiatura",
        "impermeabilizzazione", "completamento", "riqualificazione energetica",
    ],
    "Edilizia": [
        "scuola", "scolastico", "asilo", "nido", "ospedale", "presidio sanitario", "casa della comunita",
        "casa della comunità", "rsa", "edificio", "fabbricato", "immobile", "palestra", "spogliatoi",
        "auditorium", "teatro", "biblioteca", "centro civico", "centro culturale", "alloggi",
        "edilizia residenziale", "municipio", "sede comunale", "caserma",
    ],
    "Agricoltura / silvicoltura": [
        "agricoltura", "agricolo", "irriguo", "irrigazione", "rurale", "forestazione", "silvicoltura",
        "azienda agricola",
    ],
}

REDUCED_SEGMENT_TERMS = {
    "Demolizioni": ["demolizione", "demolizioni", "abbattimento"],
    "Impiantisti sottoservizi": [
        "fognatura", "acquedotto", "rete idrica", "acque reflue", "depurazione", "depuratore",
        "sottoservizi", "cavidotto", "condotta",
    ],
    "Lavori pubblici strade": [
        "strada", "strade", "viabilita", "viabilità", "pavimentazione stradale", "rotatoria", "marciapiede",
        "ponte", "pista ciclabile", "illuminazione pubblica",
    ],
    "Verde": ["verde", "parco", "giardino", "giardini", "arredo urbano", "area verde", "verde pubblico"],
    "Bonifiche e gestione rifiuti": ["bonifica", "rifiuti", "discarica", "trattamento rifiuti", "amianto"],
    "Industria": [
        "capannone", "magazzino", "logistica", "area produttiva", "zona industriale", "stabilimento",
        "stoccaggio",
    ],
    "Impiantisti": [
        "impianto elettrico", "impianti elettrici", "impianto termico", "climatizzazione", "fotovoltaico",
        "efficientamento energetico", "centrale termica", "illuminazione", "antincendio", "impiantistico",
    ],
    "Completamento e finitura edifici": [
        "copertura", "tetto", "infissi", "serramenti", "facciata", "facciate", "rivestimenti", "finiture",
        "pavimentazione interna", "impermeabilizzazione", "completamento",
    ],
    "Edilizia": [
        "scuola", "scolastico", "asilo", "nido", "ospedale", "casa della comunita", "casa della comunità",
        "rsa", "edificio", "fabbricato", "immobile", "palestra", "spogliatoi", "auditorium", "teatro",
        "biblioteca", "centro civico", "centro culturale", "alloggi", "municipio", "sede comunale",
    ],
    "Agricoltura / silvicoltura": ["agricoltura", "agricolo", "irriguo", "irrigazione", "rurale", "forestazione", "silvicoltura"],
}
REDUCED_SEGMENT_WEIGHTS = {
    "Edilizia": 30, "Completamento e finitura edifici": 25, "Impiantisti sottoservizi": 25,
    "Lavori pubblici strade": 24, "Industria": 18, "Demolizioni": 16, "Verde": 12,
    "Agricoltura / silvicoltura": 10, "Impiantisti": 10, "Bonifiche e gestione rifiuti": 8,
    "Altro": -10,
}

# Category (lower case) that always adds a segment.
CATEGORY_SEGMENTS_CONTAINED = {
    "infrastrutture / parcheggi": "Lavori pubblici strade",
    "industriale / logistica": "Industria",
}
BUILDING_CATEGORIES = (
    "scuole / formazione", "sanità / rsa", "sport / impianti sportivi", "cultura / centri civici",
    "edilizia pubblica", "residenziale pubblico / ers",
)
URBAN_CATEGORY = "riqualificazione urbana"
ENVIRONMENT_CATEGORY = "ambiente / rifiuti / depurazione"
ENVIRONMENT_UTILITY_TERMS = ["fognatura", "acquedotto", "depurazione", "acque reflue"]

# -- clients and macro projects ----------------------------------------------

LOCAL_CLIENT_MARKERS = [
    "COMUNE", "PROVINCIA", "CITTA' METROPOLITANA", "CITTÀ METROPOLITANA", "REGIONE", "AZIENDA USL", "ASL",
    "AZIENDA OSPEDALIERA", "UNIONE DEI COMUNI",
]
MACRO_VALUE = 100_000_000.0
MACRO_TERMS = [
    "autostrada", "autostradale", "ferrovia", "ferroviario", "alta velocità", "alta velocita", "concessione",
    "raccordo autostradale", "collegamento autostradale", "corridoio", "rete elettrica nazionale", "hvdc",
    "terna", "elettrodotto nazionale", "metropolitana",
]

# -- thresholds and points ---------------------------------------------------

MIN_PROJECT_VALUE = 200_000.0

COMMERCIAL_VALUE_STEPS = (
    (10_000_000.0, 35), (5_000_000.0, 30), (1_000_000.0, 22), (300_000.0, 12), (200_000.0, 6),
)
COMMERCIAL_VALUE_BELOW = -20

OPERATIONAL_VALUE_STEPS = (
    (500_000_000.0, -20), (100_000_000.0, -10), (50_000_000.0, 8), (20_000_000.0, 20), (5_000_000.0, 30),
    (1_000_000.0, 28), (500_000.0, 18), (200_000.0, 10),
)
OPERATIONAL_VALUE_BELOW = -30
YEAR_STEPS = ((2024, 15), (2022, 12), (2020, 6), (2018, 0), (2015, -8))
YEAR_BELOW = -15
SHORTLIST_SCORE = 45

WIDE_BANDS = (
    (1_000_000_000.0, ">= 1B"), (500_000_000.0, "500M - 1B"), (100_000_000.0, "100M - 500M"),
    (50_000_000.0, "50M - 100M"), (20_000_000.0, "20M - 50M"), (5_000_000.0, "5M - 20M"),
    (1_000_000.0, "1M - 5M"), (500_000.0, "500k - 1M"), (200_000.0, "200k - 500k"),
)
NARROW_BANDS = ((100_000_000.0, ">= 100M"),) + WIDE_BANDS[3:]
LOWEST_BAND = "< 200k"

MID_MARKET = (1_000_000.0, 50_000_000.0)

GENERIC_TITLE_TERMS = [
    "TERRITORIO COMUNALE", "EDIFICI DEMANIALI", "EDIFICI SCOLASTICI", "SERVIZIO DI MANUTENZIONE",
    "MANUTENZIONE ORDINARIA", "VERDE", "RIFACIMENTO SERVIZI IGIENICI", "PIAZZALE", "ARREDAMENTO URBANO",
]
SUSPICIOUS_TITLE_TERMS = [
    "SERVIZI IGIENICI", "VERDE", "MUNICIPIO", "PIAZZALE", "SCUOLA MEDIA", "URBANIZZAZIONE PRIMARIA",
]

MIN_AWARD = 100_000.0
RATIO_WINDOW = (0.005, 1.50)
AWARDED_WORD = "AGGIUDICATA"
AWARD_WEIGHTS = (
    (0.50, "Appalto principale / molto rilevante"), (0.10, "Lotto rilevante"),
    (0.01, "Lotto / servizio significativo"),
)
AWARD_WEIGHT_BELOW = "Affidamento minore"
AWARD_WEIGHT_UNKNOWN = "Non valutabile"
RATIO_NOTES = {
    "missing": "Valore progetto assente o non valutabile",
    "high": "Importo aggiudicazione superiore al 150% del valore progetto",
    "low": "Importo aggiudicazione inferiore allo 0,5% del valore progetto",
    "ok": "Rapporto importo/valore coerente",
}

EVIDENCE_LEVELS = ("confirmed", "small", "review", "technical", "none")

QUALITY_ISSUES = (
    "missing_cup", "non_assegnata", "ambigua", "missing_region", "missing_province", "missing_municipality",
    "missing_project_value", "missing_source_url",
)
INFO_ISSUES = ("missing_project_value",)

SHARD_MAX_MB = 90.0
SHARD_GLOBAL_WARN_MB = 95.0
SHARD_WARN_MB, SHARD_CRITICAL_MB = 45.0, 90.0

JSON_ROOT_KEYS = ("projects", "records", "items", "data", "rows")

METADATA_FIELDS = (
    "title", "client", "primary_segment", "segment", "region", "province", "municipality", "value_eur",
    "project_value", "branch", "source_url",
)

SIGNATURE_FIELDS = (
    "title", "segment", "region", "province", "municipality", "project_value", "client", "contractors",
    "contractor_tax_codes", "contractors_summary", "award_date", "award_result", "award_amount_eur",
    "awards_count", "has_award", "branch",
)

# -- geography ---------------------------------------------------------------

AREA_BY_REGION = {
    "VALLE D'AOSTA": "Nord-Ovest", "VALLE D AOSTA": "Nord-Ovest", "PIEMONTE": "Nord-Ovest",
    "LIGURIA": "Nord-Ovest", "LOMBARDIA": "Nord-Ovest",
    "VENETO": "Nord-Est", "FRIULI-VENEZIA GIULIA": "Nord-Est", "FRIULI VENEZIA GIULIA": "Nord-Est",
    "TRENTINO-ALTO ADIGE": "Nord-Est", "TRENTINO ALTO ADIGE": "Nord-Est",
    "EMILIA-ROMAGNA": "Centro", "EMILIA ROMAGNA": "Centro", "TOSCANA": "Centro", "UMBRIA": "Centro",
    "MARCHE": "Centro", "SARDEGNA": "Centro",
    "ABRUZZO": "Sud", "MOLISE": "Sud", "LAZIO": "Sud", "PUGLIA": "Sud", "CAMPANIA": "Sud",
    "BASILICATA": "Sud", "CALABRIA": "Sud", "SICILIA": "Sud",
}
AREA_ORDER = ("Nord-Ovest", "Nord-Est", "Centro", "Sud")
NO_AREA = "Non classificata"

PROVINCE_ALIASES = {
    "MONZA E DELLA BRIANZA": "MB", "MONZA BRIANZA": "MB", "FORLI CESENA": "FC", "FORLI": "FC",
    "REGGIO NELL EMILIA": "RE", "REGGIO EMILIA": "RE", "BOLZANO": "BZ", "BOLZANO BOZEN": "BZ", "BOZEN": "BZ",
    "AOSTA": "AO", "VALLE D AOSTA": "AO", "SUD SARDEGNA": "SU",
    "CITTA METROPOLITANA DI CAGLIARI": "CA", "CITTA METROPOLITANA DI FIRENZE": "FI",
    "CITTA METROPOLITANA DI ROMA CAPITALE": "RM", "CITTA METROPOLITANA DI MILANO": "MI",
    "CITTA METROPOLITANA DI NAPOLI": "NA", "CITTA METROPOLITANA DI TORINO": "TO",
    "CITTA METROPOLITANA DI BOLOGNA": "BO", "CITTA METROPOLITANA DI GENOVA": "GE",
    "CITTA METROPOLITANA DI VENEZIA": "VE", "CITTA METROPOLITANA DI BARI": "BA",
    "CITTA METROPOLITANA DI REGGIO CALABRIA": "RC", "CITTA METROPOLITANA DI SASSARI": "SS",
    "MASSA CARRARA": "MS", "LA SPEZIA": "SP", "PESARO E URBINO": "PU", "BARLETTA ANDRIA TRANI": "BT",
    "VERBANO CUSIO OSSOLA": "VB", "VIBO VALENTIA": "VV", "ASCOLI PICENO": "AP", "REGGIO CALABRIA": "RC",
    "CALTANISSETTA": "CL", "CARBONIA IGLESIAS": "CI", "GALLURA NORD EST SARDEGNA": "OT",
    "MEDIO CAMPIDANO": "VS", "OGLIASTRA": "OG", "OLBIA TEMPIO": "OT",
}

# Territorial assignments of the last cascade steps; keys are normalised like the data.
MUNICIPALITY_BRANCHES = {"VERMEZZO CON ZELO": "Milano Sud"}
REGION_BRANCHES = {
    "ABRUZZO": "Roma Nomentana", "MARCHE": "Rimini", "SICILIA": "Catania", "CALABRIA": "Cosenza",
    "FRIULI VENEZIA GIULIA": "Udine", "PUGLIA": "Bari", "UMBRIA": "Perugia", "VALLE D AOSTA": "Torino",
}
PROVINCE_BRANCHES = {
    "PESARO E URBINO": "Rimini", "PU": "Rimini", "ALESSANDRIA": "Milano Sud", "AL": "Milano Sud",
    "AOSTA": "Torino", "AO": "Torino", "ASTI": "Torino", "AT": "Torino", "AVELLINO": "Napoli",
    "AV": "Napoli", "BARLETTA ANDRIA TRANI": "Bari", "BT": "Bari", "BELLUNO": "Treviso", "BL": "Treviso",
    "BENEVENTO": "Napoli", "BN": "Napoli", "BIELLA": "Torino", "BI": "Torino", "PISTOIA": "Firenze",
    "PT": "Firenze", "PRATO": "Firenze", "PO": "Firenze", "FIRENZE": "Firenze", "FI": "Firenze",
    "SIENA": "Firenze", "SI": "Firenze", "AREZZO": "Firenze", "AR": "Firenze", "POTENZA": "SALERNO",
    "PZ": "SALERNO", "MATERA": "Bari", "MT": "Bari", "CAMPOBASSO": "Bari", "CB": "Bari",
    "ISERNIA": "Frosinone", "IS": "Frosinone", "VERCELLI": "Torino", "VC": "Torino",
    "VERBANO CUSIO OSSOLA": "Milano Ovest", "VB": "Milano Ovest", "NOVARA": "Milano Ovest",
    "NO": "Milano Ovest", "COMO": "Milano Nord", "CO": "Milano Nord", "VARESE": "Milano Ovest",
    "VA": "Milano Ovest", "PAVIA": "Milano Sud", "PV": "Milano Sud", "LODI": "Milano Est",
    "LO": "Milano Est", "MANTOVA": "Verona", "MN": "Verona", "CREMONA": "Brescia", "CR": "Brescia",
    "REGGIO NELL EMILIA": "Parma", "REGGIO EMILIA": "Parma", "RE": "Parma", "FORLI CESENA": "Rimini",
    "FC": "Rimini", "FERRARA": "Bologna", "FE": "Bologna", "PIACENZA": "Parma", "PC": "Parma",
    "RAVENNA": "Rimini", "RA": "Rimini", "MODENA": "Sassuolo", "MO": "Sassuolo", "VICENZA": "Padova",
    "VI": "Padova", "ROVIGO": "Padova", "RO": "Padova", "SAVONA": "Albenga", "SV": "Albenga",
    "IMPERIA": "Albenga", "IM": "Albenga", "LA SPEZIA": "Lucca", "SP": "Lucca", "GROSSETO": "Livorno",
    "GR": "Livorno", "RIETI": "Roma Nomentana", "RI": "Roma Nomentana", "LATINA": "Frosinone",
    "LT": "Frosinone", "BARI": "Bari", "BA": "Bari", "BRINDISI": "Bari", "BR": "Bari", "FOGGIA": "Bari",
    "FG": "Bari", "LECCE": "Bari", "LE": "Bari", "TARANTO": "Bari", "TA": "Bari", "PERUGIA": "Perugia",
    "PG": "Perugia", "TERNI": "Perugia", "TR": "Perugia", "NUORO": "Sassari", "NU": "Sassari",
    "ORISTANO": "Cagliari", "OR": "Cagliari", "MONZA E DELLA BRIANZA": "Milano Nord",
    "MONZA BRIANZA": "Milano Nord", "MB": "Milano Nord", "PISA": "Livorno", "PI": "Livorno",
    "CASERTA": "Napoli", "CE": "Napoli", "VITERBO": "Roma Nomentana", "VT": "Roma Nomentana",
    "MASSA CARRARA": "Lucca", "MS": "Lucca", "VALLE D AOSTA": "Torino", "CARBONIA IGLESIAS": "Cagliari",
    "CI": "Cagliari", "CITTA METROPOLITANA DI CAGLIARI": "Cagliari", "CA": "Cagliari",
    "CITTA METROPOLITANA DI SASSARI": "Sassari", "SS": "Sassari", "GALLURA NORD EST SARDEGNA": "Sassari",
    "MEDIO CAMPIDANO": "Cagliari", "VS": "Cagliari", "OGLIASTRA": "Cagliari", "OG": "Cagliari",
    "OLBIA TEMPIO": "Sassari", "OT": "Sassari", "SUD SARDEGNA": "Cagliari", "SU": "Cagliari",
}
MULTI_BRANCH_PROVINCES = ("ROMA", "RM", "MILANO", "MI")
MULTI_BRANCH_NAMES = ("ROMA", "MILANO")

# -- page extraction ---------------------------------------------------------

# First match wins; the group is the value.
PAGE_MUNICIPALITY = (
    r"\bcomune di ([A-ZÀ-ÖØ-Ýa-zà-öø-ÿ'’\-\s]+?)(?:[,.;)]|\s+e\s+|\s+in\s+provincia|\s+nel\s+territorio|$)",
    r"\bcomuni di ([A-ZÀ-ÖØ-Ýa-zà-öø-ÿ'’\-\s,]+?)(?:[.;)]|\s+in\s+provincia|\s+nel\s+territorio|$)",
)
PAGE_PROPONENT = (
    r"Proponente\s+(.+?)(?:Procedura|Localizzazione|Documentazione|$)",
    r"Società proponente\s+(.+?)(?:Procedura|Localizzazione|Documentazione|$)",
)
PAGE_TITLE = r"(Progetto[^.]{20,250})"
PAGE_PROVINCE = r"\(([A-Z]{2})\)"

ENERGY_SECTORS = {
    "agrivoltaico": ["agrivoltaic", "agrovoltaic", "agri-voltaic"],
    "fotovoltaico": ["fotovoltaic"],
    "eolico": ["eolico", "aerogenerator"],
    "energia": ["bess", "accumulo", "storage"],
    "biometano": ["biometano"],
    "rifiuti": ["rifiuti"],
    "depurazione": ["depurator"],
}
DEFAULT_ENERGY_SECTOR = "energia"

DETAIL_LABELS = [
    "CUP:", "Totale costo previsto", "Totale Finanziamento pubblico previsto", "Anno decisione", "Stato",
    "Soggetto titolare", "Descrizione intervento", "Struttura/Infrastruttura oggetto dell'intervento",
    "Indirizzo o area di riferimento", "Regione", "Provincia", "Comune", "Classificazione", "Tipologia",
    "Area d'intervento", "Settore", "Sottosettore", "Categoria", "Data di generazione",
]

# -- header candidates of the tender tables ----------------------------------

TENDER_CODE_HEADERS = ["CIG", "codice_cig", "codice identificativo gara"]
PROJECT_CODE_HEADERS = ["CUP", "codice_cup", "codice unico progetto"]
LINK_PROJECT_HEADERS = ["cup", "codicecup", "codicecupopera", "idcup"]
CONTRACTOR_HEADERS = {
    "contractor_name": [
        "denominazione", "denominazione aggiudicatario", "ragione sociale", "operatore economico",
        "aggiudicatario", "denominazione operatore economico",
    ],
    "contractor_tax_code": [
        "codice fiscale", "cf", "codice fiscale aggiudicatario", "codice fiscale operatore economico",
        "codice fiscale oe",
    ],
    "contractor_vat": [
        "partita iva", "piva", "p.iva", "partita iva aggiudicatario", "partita iva operatore economico",
    ],
    "contractor_role": ["ruolo", "ruolo operatore", "tipo ruolo", "tipo soggetto"],
}
OUTCOME_COLUMNS = {
    "data_aggiudicazione_definitiva": "award_date", "esito": "award_result", "cod_esito": "award_result_code",
    "criterio_aggiudicazione": "award_criteria", "data_comunicazione_esito": "award_notice_date",
    "importo_aggiudicazione": "award_amount_eur", "ribasso_aggiudicazione": "award_discount",
    "numero_offerte_ammesse": "admitted_offers", "numero_offerte_escluse": "excluded_offers",
    "num_imprese_offerenti": "bidders_count", "flag_subappalto": "subcontracting",
    "id_aggiudicazione": "id_aggiudicazione", "PRESTAZIONI_COMPRESE": "included_services",
}

# -- quality flags -----------------------------------------------------------

QUALITY_PENALTIES = {
    "NO_ANAC_MATCH": -8, "OLD_CUP": -12, "CUP_YEAR_UNKNOWN": -5, "GENERIC_OR_MAINTENANCE_TITLE": -15, "HIGH_VALUE_WITHOUT_ANAC": -12,
    "OLD_HIGH_VALUE": -15, "VALUE_SUSPICIOUS": -25, "BRANCH_MISSING": -8, "BRANCH_AMBIGUOUS": -4, "BRANCH_NOT_ASSIGNED": -10,
}
