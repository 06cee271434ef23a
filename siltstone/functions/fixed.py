"""Word lists, tables and patterns that results depend on."""

# Words that retrieval ignores.
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "to", "for", "with", "and", "or", "by", "from", "at", "as", "be",
    "this", "that", "it", "its", "we", "our", "their", "has", "have", "been", "can", "may", "will", "would", "could", "should",
]

# Words that a conjunctive query drops.
QUERY_NOISE = ["of", "for", "in", "on", "the", "a", "an", "is", "are", "and", "or", "with", "by", "to", "at", "as"]

# Unit spelling -> unit, for extracted values.
UNITS_A = {
    "kj/mol": "kj/mol", "kj / mol": "kj/mol", "kj mol-1": "kj/mol", "kj mol1": "kj/mol", "kjmol": "kj/mol",
    "mmol/g": "mmol/g", "mmol / g": "mmol/g", "mol/kg": "mol/kg", "mmol/cm3": "mmol/cm3", "mg/g": "mg/g", "m2/g": "m2/g",
    "wt%": "wt%", "wt %": "wt%", "bar": "bar", "ppm": "ppm", "ev": "ev", "h": "h", "min": "min", "%": "%", "k": "k",
}

# Unit spelling -> unit, for claims.
UNITS_B = {
    "kj/mol": "kj/mol", "kj / mol": "kj/mol", "kj mol⁻¹": "kj/mol", "kj mol-1": "kj/mol", "kj mol¹": "kj/mol", "kjmol": "kj/mol",
    "千焦/摩尔": "kj/mol", "千焦/摩": "kj/mol", "mmol/g": "mmol/g", "mmol / g": "mmol/g", "mmol g⁻¹": "mmol/g", "毫摩尔/克": "mmol/g", "毫摩/克": "mmol/g",
    "mol/kg": "mol/kg", "mmol/cm3": "mmol/cm3", "mg/g": "mg/g", "m2/g": "m2/g", "wt%": "wt%", "wt %": "wt%", "bar": "bar", "ppm": "ppm", "ev": "ev",
    "h": "h", "min": "min", "%": "%", "% rh": "%", "k": "k", "µv/k": "µv/k", "uv/k": "µv/k", "μv/k": "µv/k",
    "w/m·k": "w/m·k", "w/mk": "w/m·k", "w m⁻¹ k⁻¹": "w/m·k", "s/cm": "s/cm", "s/m": "s/m",
}

# Unit -> physical category.
UNIT_CATEGORY = {
    "k": "temperature", "kelvin": "temperature", "kelvins": "temperature", "°c": "temperature", "℃": "temperature", "°f": "temperature",
    "bar": "pressure", "kpa": "pressure", "mpa": "pressure", "atm": "pressure", "pa": "pressure", "torr": "pressure",
    "mmol/g": "capacity", "mmol/cm3": "capacity", "mol/kg": "capacity", "mg/g": "capacity", "cm3/g": "capacity", "m2/g": "surface_area",
    "kj/mol": "energy", "ev": "energy", "h": "time", "hr": "time", "min": "time", "s": "time", "%": "ratio", "wt%": "ratio", "ppm": "ratio",
}

# Plausible range of a value by unit.
UNIT_RANGE = {
    "mmol/g": (0.05, 60.0), "mol/kg": (0.05, 60.0), "mmol/cm3": (0.05, 60.0), "mg/g": (0.5, 2000.0), "kj/mol": (5.0, 500.0), "m2/g": (5.0, 10000.0),
    "bar": (0.01, 200.0), "k": (50.0, 5000.0), "%": (0.1, 100.0), "ev": (0.01, 50.0), "h": (0.1, 1000.0), "min": (0.1, 10000.0),
    "µv/k": (0.1, 2000.0), "uv/k": (0.1, 2000.0), "μv/k": (0.1, 2000.0), "w/m·k": (0.01, 500.0), "w/mk": (0.01, 500.0),
    "s/cm": (0.001, 100000.0), "s/m": (0.001, 100000.0), "dimensionless": (0.01, 20.0),
}

# Accepted units and the property words that select them.
UNIT_BUCKETS = [
    (["mmol/g", "mol/kg", "mmol/cm3", "mg/g", "wt%"], ["容量", "capacity", "uptake", "loading", "吸附", "capture", "adsorption"]),
    (["kj/mol"], ["焓", "qst", "enthalpy", "等量吸附热", "吸附热"]),
    (["m2/g"], ["bet", "surface area", "比表面积", "表面积"]),
    (["bar"], ["压力", "pressure"]),
    (["k"], ["温度", "temperature"]),
    (["%", "wt%"], ["效率", "efficiency"]),
    (["ev"], ["带隙", "band gap", "bandgap", "禁带", "能隙", "eg", "e_g"]),
    (["µv/k", "uv/k"], ["seebeck", "塞贝克", "热电势"]),
    (["w/m·k", "w/mk"], ["热导率", "thermal conductivity"]),
    (["s/cm", "s/m"], ["电导率", "electrical conductivity"]),
    (["dimensionless"], ["zt", "热电优值", "figure of merit", "优值"]),
]

# A value and its unit.
VALUE_UNIT = (
    r"(?i)(\d+(?:\.\d+)?)\s*(kj\s*/\s*mol|kj\s*mol\s*[-]*[1]?|mmol\s*/\s*g\b|mol\s*/\s*kg\b|mmol\s*/\s*cm3\b|"
    r"mg\s*/\s*g\b|m2\s*/\s*g\b|wt\s*%|bar\b|ppm\b|ev\b|k\b|min\b|h\b|%\s*(?:rh)?)"
)

# A claim: prefix, low, high, unit.
CLAIM = (
    r"(?i)([≈~～><≥≤]?\s*)(\d+(?:\.\d+)?)\s*(?:[-–—～~至到]\s*(\d+(?:\.\d+)?))?\s*"
    r"(kj\s*/\s*mol|kj\s*mol\s*[⁻¹−\-–—]*[¹1]?|mmol\s*/\s*g\b|mol\s*/\s*kg\b|mmol\s*/\s*cm3\b|mg\s*/\s*g\b|m2\s*/\s*g\b|wt\s*%|"
    r"bar\b|ppm\b|ev\b|k\b|min\b|h\b|%\s*(?:rh)?|千焦\s*/\s*摩[尔]?|毫摩[尔]?\s*/\s*克)"
)

# Words near a bare unit letter that make it a unit.
UNIT_CONTEXT = {
    "k": "温度|[Tt]emp|吸附|反应|开[尔文]|kelvin",
    "h": "[Hh]our|[Hh]rs?|小时|[Tt]ime|暴露|时间",
    "min": "[Mm]inute|分钟|[Tt]ime|暴露|时间",
}

# Anchors of the piecewise-linear score stretch.
STRETCH = [(0.0, 0.02), (0.3, 0.22), (0.5, 0.42), (0.65, 0.62), (0.8, 0.82), (0.9, 0.93), (1.0, 1.0)]

# Weights of coverage, co-occurrence and prior by kind of hypothesis.
TYPE_WEIGHTS = {"unexplored": (0.45, 0.30, 0.25), "link": (0.25, 0.45, 0.30), "contra": (0.20, 0.30, 0.50)}

# Property word -> search words.
PROPERTY_SEARCH = {
    "选择性": ["selectivity", "separation factor"], "容量": ["capacity", "uptake", "loading"], "吸附": ["adsorption", "uptake", "capture"],
    "焓": ["isosteric heat", "qst", "enthalpy"], "再生": ["regeneration", "working capacity", "energy"], "稳定性": ["stability", "degradation", "cyclability"],
    "扩散": ["diffusion", "kinetics"], "催化": ["catalysis", "tof", "conversion", "activity"], "效率": ["efficiency"],
    "能耗": ["energy penalty", "regeneration energy"], "循环": ["cyclability", "cycle"],
}
DEFAULT_SEARCH = ["adsorption", "capacity", "selectivity"]

# Property word -> equivalent keys.
PROPERTY_KEYS = {
    "选择性": ["selectivity", "separation factor", "选择性"], "容量": ["capacity", "uptake", "loading", "容量"], "吸附": ["adsorption", "uptake", "capture", "吸附"],
    "焓": ["isosteric heat", "qst", "enthalpy", "吸附热", "等量吸附热"], "热": ["qst", "enthalpy", "heat", "吸附热"], "再生": ["regeneration", "working capacity", "energy", "再生"],
    "稳定性": ["stability", "degradation", "cyclability", "稳定"], "扩散": ["diffusion", "kinetics", "扩散"], "催化": ["catalysis", "tof", "conversion", "activity", "催化"],
    "效率": ["efficiency", "效率"], "能耗": ["energy penalty", "regeneration energy", "能耗"], "循环": ["cyclability", "cycle", "循环"],
    "湿态": ["humid", "humidity", "water", "rh", "湿度", "湿"], "保持率": ["retention", "keep", "retain", "保持率", "衰减"], "密度": ["density", "浓度", "密度"],
    "oms": ["oms", "open metal site", "open metal", "金属位点", "配位不饱和"], "缺陷": ["defect", "缺陷"], "杂质": ["impurity", "no2", "so2", "杂质"],
    "no2": ["no2", "nitrogen dioxide"], "so2": ["so2", "sulfur dioxide"],
}

# Symbols of the elements.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn"
).split()
FORMULA = r"(?<![A-Za-z0-9])(?:[A-Z][a-z]?(?:\d+(?:\.\d+)?|x|y|z|')?)+(?![A-Za-z0-9])"

# Entities of a query: the first hit of each class counts.
QUERY_ENTITIES = {
    "material": r"(?i)\b[A-Z][a-z]?[0-9]*(?:[A-Z][a-z]?[0-9]*)+\b",
    "property": r"(?i)\b(?:band gap|conductivity|thermal conductivity|electrical conductivity|mechanical strength|hardness|catalytic activity|stability|efficiency|PCE|power conversion efficiency|figure of merit|ZT|carrier mobility|Seebeck coefficient|capacity|energy density|power density|corrosion resistance|adsorption capacity|selectivity|conversion rate|yield|degradation|phase transition|magnetic)\b",
    "method": r"(?i)\b(?:DFT|density functional theory|molecular dynamics|MD|Monte Carlo|MCTS|genetic algorithm|Bayesian optimization|machine learning|deep learning|neural network|GNN|graph neural network|transfer learning|active learning|high-throughput|combinatorial|sol-gel|hydrothermal|CVD|PVD|ALD|MBE|sputtering|electrodeposition|XRD|TEM|SEM|AFM|XPS|NMR|Raman|FTIR)\b",
}

# Entities of a document by class.
DOCUMENT_ENTITIES = {
    "materials": [
        r"\b[A-Z][a-z]?[0-9]*(?:[A-Z][a-z]?[0-9]*)+(?:\b|_)", r"(?i)\b(?:perovskite|MOF|zeolite|graphene|MXene|TMD|HEA|COF|QD)\b", r"(?i)\b(?:metal-organic framework|covalent organic framework)\b",
        r"(?i)\b(?:oxide|sulfide|nitride|carbide|alloy|ceramic|polymer|composite)\b", r"(?i)\b(?:ZIF-\d+|UiO-\d+|MIL-\d+|HKUST-\d+|IRMOF-\d+)\b",
    ],
    "properties": [
        r"(?i)\b(?:band gap|conductivity|resistivity|capacitance|dielectric|permittivity)\b", r"(?i)\b(?:thermal conductivity|thermal expansion|specific heat|heat capacity)\b",
        r"(?i)\b(?:figure of merit|ZT|Seebeck coefficient|carrier mobility|carrier concentration)\b", r"(?i)\b(?:adsorption capacity|uptake|permeability|permeance|separation factor)\b",
        r"(?i)\b(?:stability|degradation|lifetime|durability|cyclability|coulombic efficiency)\b",
    ],
    "methods": [
        r"(?i)\b(?:DFT|density functional theory|HF|CCSD|MP2|GW approximation)\b", r"(?i)\b(?:molecular dynamics|MD simulation|Monte Carlo|MCTS|kinetic Monte Carlo)\b",
        r"(?i)\b(?:machine learning|deep learning|neural network|CNN|GNN|random forest|SVM)\b", r"(?i)\b(?:XRD|XPS|TEM|SEM|STEM|AFM|STM|NMR|EPR|FTIR|Raman|XANES|EXAFS)\b",
        r"(?i)\b(?:CVD|PVD|ALD|MBE|sputtering|electrodeposition)\b", r"(?i)\b(?:Bayesian optimization|genetic algorithm|active learning|transfer learning)\b",
    ],
}

# Evidence codes, most specific first.
EVIDENCE_CODES = [
    r"(?i)\bTE\d+(?:\s*[/,;]\s*TE?\d+)*", r"(?i)\bp\d+(?:\s*[,;]\s*p\d+)*", r"\b10\.\d{4,}/[A-Za-z0-9.\-_()/]+", r"\bPhysRev[A-Za-z.]+\.[\d.]+", r"\bs\d{5}-[\w\-]+",
    r"\b\d{4}\.\d{4,5}[vV]\d\b", r"\b\d{4}-\d{4}/[a-z0-9]+\b", r"\b[a-z]{2,8}\.\d{5,}[a-z]?\b", r"\b[a-z]{2,8}\.\d{4}[a-z]?\b", r"\b[0-9a-f]{20,}\b", r"\b[A-Z]{2,4}\d{2,}\b",
]

# A window of values: two numbers and a unit, or two numbers before a word that says so.
WINDOW_UNIT = r"(?i)(\d+(?:\.\d+)?)\s*[-–—~～至到]\s*(\d+(?:\.\d+)?)\s*(?:kJ/mol|kJ mol|kJ·mol|kcal/mol|J/mol|kWh/kg|mmol/g|mmol/cm3|mol/kg|mg/g|wt%|m2/g|bar|kPa|MPa|K|%|eV|h|min)"
WINDOW_WORD = r"(?i)(\d+(?:\.\d+)?)\s*[-–—~～至到]\s*(\d+(?:\.\d+)?)\s*(?=窗口|区间|范围|甜点|window|range|sweet)"

# What counts as a quantity, a source, a conclusion, a placeholder in a memory entry.
QUANTITY = (
    r"(?:\d+(?:\.\d+)?\s*(?:"
    r"mmol/g|mol/g|mg/g|ml/g|mL/g|µg/g|ug/g|wt%|wt\.%|at%|vol%|"
    r"K\b|°C|℃|eV|kJ/mol|kJ\s?mol|kcal/mol|cal/mol|kJ·mol|"
    r"MPa|GPa|kPa|Pa\b|bar\b|Torr|mmHg|"
    r"nm\b|µm|μm|mm\b|cm\b|Å\b|cm−1|cm-1|"
    r"s\b|min\b|h\b|day\b|yr\b|"
    r"%\b|ppm|ppb|RH\b|m²/g|m2/g|cc/g|cm³/g|cm3/g))"
    r"|\d+\.\d+"
    r"|\d+(?:\.\d+)?\s*[-–—→↔~]\s*\d+(?:\.\d+)?"
    r"|\d+\s*[万亿]"
    r"|\d+(?:\.\d+)?\s*(?:篇|个|种|例|组|轮|倍|次|天|小时|分钟)"
)
SOURCE = (
    r"\[[0-9]+\]|\b[pP]\s?\d{1,4}\b|\barXiv[:\s/]|\bdoi\b|doi\.org|https?://|[（(]\s*(?:19|20)\d{2}\s*[)）]|\b(?:19|20)\d{2}\b"
    r"|文献|参考文献|\bJACS\b|\bNature\b|\bScience\b|\bAngew\b|\bACS\b|\bRSC\b|\bElsevier\b|\bWiley\b|\bSpringer\b"
)
CONCLUSION = (
    r"发现|表明|显示|说明|证实|验证|确证|揭示|结论|意味着|推断|推测|优于|高于|低于|好于|大于|小于|提升|提高|增强|减弱|下降|降低|"
    r"达到|突破|创纪录|显著|稳定|支持|驳斥|反驳|[-–—→↔↑↓><≥≤=]|\bvs\.?\b|相比|对比|强于|不如|弱于"
)
PLACEHOLDER = r"(?i)待补充|待完善|待更新|后续补充|稍后补充|此处补|补记|省略|\bTBD\b|\bTODO\b|\bFIXME\b|placeholder|占位|未完成|稍后更新|lorem ipsum|内容待|细节待"

# Words that say nothing to a novelty search, and property words that do.
QUERY_STOPWORDS = """a an the and or of to in on at for with from by via that this these those their there its it is are was were be been
based using used use method methods approach approaches system systems study studies research material materials property properties relationship
relationships discovery analysis analyses design designs tool tools gap gaps paper papers result results effect effects impact role
toward towards about between after before during through new novel high low higher lower large small significant strong weak potential possible
general specific overall related relation depend dependence dependency influence trend mechanism mechanisms predict prediction correlate correlation
model modeling simulation simulated computational calculation calculated important key vs under over into as if but not no than
determined expected found show shown demonstrate""".split()
PROPERTY_TERMS = """adsorption capacity selectivity uptake loading stability isotherm enthalpy qst diffusion permeability conductivity barrier moisture humidity
pressure temperature composition ratio defect bandgap porosity pore kinetics selective recovery regeneration energy cycling hydrophobicity
hydrophilicity surface capture metastability""".split()

# --- points of a property in literature ---

# A value with one of the units that a property may have; a structure variable: temperature, pressure, composition, percentage.
POINT_VALUE = (
    r"(?i)(\d+(?:\.\d+)?)\s*(mmol/g|mol/kg|mmol/cm3|mg/g|kJ/mol|wt%|m2/g|bar|K|%|h|min|eV|"
    r"µV/K|uV/K|μV/K|W/m·K|W/mK|mW/m·K|mW/mK|S/cm|mS/cm|S/m)\b"
)
POINT_X = (
    r"(?i)(\d+(?:\.\d+)?)\s*(?:K|°C|℃)\b|(\d+(?:\.\d+)?)\s*(?:bar|atm|kPa|GPa|MPa)\b|"
    r"(?:x\s*[:=：]\s*|比例\s*[:=：]\s*|组分\s*[:=：]\s*|composition\s*[:=：]\s*|doping\s*[:=：])\s*(\d+(?:\.\d+)?)|"
    r"(\d+(?:\.\d+)?)\s*%(?!\s*(?:RH|rh|湿度))"
)
# A number on its own, what stands in brackets, the ends of a sentence, "from A to B" of a structure variable.
BARE_NUMBER = r"(?<![a-z0-9.\-])(\d+(?:\.\d+)?)(?![\d.eE])"
BRACKETED = r"[（(]([^）)]+)[）)]"
POINT_SENTENCE = r"[.!?。！？;；\n]+"
X_FROM_TO = r"(?i)\bfrom\s+(\d+(?:\.\d+)?)\s+to\s+(\d+(?:\.\d+)?)\s*(K|°C|℃|bar|atm|kPa)\b"
# Words in the head of a column of x or of y, and of its kinds; what a column of figures of merit is called.
X_HEAD = r"temp|temperature|温度|pressure|压力|composition|组分|比例|doping|\bt\b"
PRESSURE_HEAD, COMPOSITION_HEAD = r"pressure|压力", r"composition|组分|比例|doping"
Y_HEAD = (
    r"capacity|uptake|adsorption|loading|capture|selectivity|容量|吸附|摄取|焓|enthalpy|heat|qst|效率|efficiency|zt|热电优值|figure of merit|"
    r"seebeck|塞贝克|热电势|功率因子|power factor|热导率|电导率|thermal conductivity|electrical conductivity"
)
MERIT_HEAD = r"\bzt\b|热电优值|figure\s*of\s*merit"

# --- pairs without units ---

# Heads of numeric columns; "X K, Y mmol/g"; "V1, V2 mmol/g".
NUMERIC_HEAD = r"[\(（].*[\)）]|[Kk]|[Jj]/mol|mmol|eV|bar|W/m|值|温度|容量|比例|组分|浓度|带隙|ZT|电导"
PAIR_AT = r"(?i)(\d+\.?\d*)\s*(?:K|°C|℃)\s*(?:[,，]?\s*)?(\d+\.?\d*)\s*(?:mmol/g|kJ/mol|eV|wt%|bar)"
PAIR_LIST = r"(\d+\.?\d*)\s*[,，]\s*(\d+\.?\d*)\s*(?:mmol/g|kJ/mol)"

# Words of a property that ask for the known range of a kind.
RANGE_WORDS = {
    "capacity": ["co2", "capacity", "adsorption", "吸附"],
    "heat": ["qst", "heat of adsorption", "binding energy", "吸附热", "结合能", "isosteric"],
    "area": ["surface area", "bet", "porosity", "比表面积", "表面积", "孔隙"],
}
