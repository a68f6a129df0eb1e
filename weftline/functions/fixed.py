"""Fixed values of the data formats: words, prefixes, headers and types that input and output files must match."""

# fixed values
ROLES = ("main", "duplicate", "reserve", "foreign")
RELATION_TYPES = {"duplicate": "Дублирующая", "reserve": "Резервная", "foreign": "Зарубежная"}
DOCUMENT_PREFIXES = ("ГОСТ Р ИСО", "ГОСТ Р", "ГОСТ", "ОСТ", "СТО", "ТУ У", "ТУ", "ISO", "ASTM", "DIN", "EN", "MIL", "API")
HEADER_ALIASES = {
    "main": ["основная марка гсм", "основная марка", "основная"],
    "duplicate": ["дублирующая марка гсм", "дублирующая марка", "дублирующая", "дубл."],
    "reserve": ["резервная марка гсм", "резервная марка", "резервная"],
    "foreign": ["зарубежная марка гсм", "зарубежная марка", "зарубежная", "иностранная марка", "импортный аналог"],
    "group": ["группа гсм", "группа"],
    "subgroup": ["подгруппа гсм", "подгруппа"],
    "ground": ["наземная техника", "наземная", "наземный"],
    "aviation": ["авиационная техника", "авиационная", "авиация"],
    "marine": ["морская техника", "морская", "морской", "флот"],
    "note": ["примечание", "примечания", "прим."],
    "brand": ["марка гсм", "марка", "наименование гсм", "наименование"],
    "purpose": ["назначение и условия применения", "назначение", "условия применения"],
    "normdoc": ["нормативный документ", "обозначение нормативного документа", "нормативная документация", "нд"],
}
BRAND_TABLE = (("main", "duplicate", "reserve", "foreign"), ("group", "subgroup", "ground", "aviation", "marine", "note"))
PURPOSE_TABLE = (("brand", "purpose"), ("group", "subgroup", "normdoc", "note"))
REPEATED_HEADER_STEMS = {"main": "основн", "duplicate": "дублир", "reserve": "резерв", "foreign": "зарубеж"}
HEADER_WORD = "марка"
YES = ("+", "да", "есть", "true", "1", "x", "х")
NO = ("-", "нет", "false", "0")
LOOKALIKES = ("ABCEHKMOPTXYILЁ|–—−", "АВСЕНКМОРТХУ11Е1---")
NO_DOCUMENT = "∅"
BLOCKING = ("ambiguous_relation_mapping", "missing_main_item", "ambiguous_purpose_match")
SHARD_NAME = r"^(.*)-(\d{5})-of-(\d{5})\.gguf$"
#: column type: relation types that it stands for
TYPED_RELATIONS = {"duplicate": ("дублирующая",), "reserve": ("резервная",), "foreign": ("зарубежная",), "duplicate_reserve": ("дублирующая", "резервная")}
FIELD, VALUE, COLUMN = "Поле", "Значение", "Колонка"
LINK = r"\s+по\s+"
RAW_DOCUMENT = r"(?:^|\s)(?:ГОСТ|ОСТ|ТУ|СТО|ASTM|ISO|DIN|SAE|API)(?:\s|$)"
REPLACED = "рекомендуется заменить устаревшую на перспективную"
MARK_TYPES = ("applicable_ground", "applicable_air", "applicable_marine")
CONJUNCTION = "и"
TEXT_TYPES = ("assignment_conditions", "nato_index")
COLUMN_TYPES = ("other", "primary", *TYPED_RELATIONS, "obsolete", "prospective", *MARK_TYPES, *TEXT_TYPES)
REGION_STATES = ("pending", "queued", "running", "recognized", "modified", "error")
#: states of work that ended with its session
UNFINISHED = ("queued", "running")
MANUAL = "manual_override"
#: category: message
FLAG_MESSAGES = {
    "mixed_latin_cyrillic": "В позиции смешаны латиница и кириллица.",
    "multiple_normdocs_in_item": "В одной атомарной позиции обнаружено несколько обозначений НД.",
    "normdoc_not_found": "Нормативный документ не найден.",
    "normdoc_without_po": "НД найден без явного шаблона «по ...».",
    "normdoc_from_separate_column": "НД взят из отдельного столбца.",
    "normdoc_conflict_with_separate_column": "НД в позиции конфликтует с отдельным столбцом.",
    "empty_brand": "После разбора не осталось названия марки.",
    "possible_continuation_row": "Строка похожа на ошибочно отделённое OCR-продолжение.",
    "ambiguous_relation_mapping": "Основную и связанную марки нельзя сопоставить однозначно.",
    "missing_main_item": "Связанная марка есть, основной марки в строке нет.",
    "ambiguous_purpose_match": "Найдено несколько разных текстов назначения.",
    "purpose_not_found": "Назначение и условия применения не найдены.",
}
UNRECOGNIZED, UNRECOGNIZED_MESSAGE = "unrecognized_", "Маркер применимости техники не распознан."
EXPORT_BRANDS = ("Марка ГСМ", "Нормативный документ", "Назначение и условия применения", "Наземная техника", "Авиационная техника", "Морская техника")
EXPORT_GROUPS = ("Группа ГСМ", "Подгруппа ГСМ", "Марка ГСМ")
EXPORT_RELATIONS = ("Марка ГСМ основная", "Тип связи", "Марка ГСМ связанная", "Примечание")
SIDECAR = ".regions.md"
PDF_BYTES, IMAGE_BYTES = 1 << 30, 32 << 20
IMAGE_KINDS = ("png", "jpeg", "webp", "bmp", "tiff")
