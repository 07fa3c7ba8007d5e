"""What the engine knows of its sources: indicators, places and names. All of it is data.

Columns of the two indicator lists are separated by '|'; selections are dimension=value pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# fixed values: national indicators: id | table | selections | unit | title
NATIONAL = """
gdp | /VEK/IS/ISI/ISI010c | SESON=SA, INDICATOR=B1GQ, ContentsCode=ISI010c1 | % YoY | GDP Growth Rate
salary | /EMP/DS/DSV/DSV010c | GRS_NET=GRS, SECTOR=TOTAL, INDICATOR=AVWAG_M, ContentsCode=DSV010c | EUR/month | Average Gross Salary
cpi | /VEK/PC/PCI/PCI021m | ECOICOP_V2=0, ContentsCode=PCI021m4 | % YoY | CPI Inflation
unemployment | /EMP/NBBA/NBBB/NBB150m | SEX=T, SESON=SA, ContentsCode=NBB1501m | % | Unemployment Rate
house_prices | /VEK/PC/PCI/PCI050c | ContentsCode=PCI050c1 | % YoY | House Price Change
retail_sales | /TIR/TI/TIT/TIT010m | ContentsCode=TIT010m | % YoY | Retail Sales Growth
industrial | /NOZ/RU/RUI/RUI020m | NACE_MIG=MIG_ING, ContentsCode=RUI020m4 | % YoY | Industrial Production Growth
population | /POP/IR/IRS/IRS010 | INDICATOR=POP_SY, ContentsCode=IRS010 | persons | Population
hotel_occupancy | /NOZ/TU/TUV/TUV010m | ContentsCode=TUV010m | % | Hotel occupancy rate
tourist_arrivals | /NOZ/TU/TUV/TUV020c | ACCOMMODATION=I551-I553, ContentsCode=TUV020c | thousands | Tourist arrivals
gov_revenue | /VEK/VF/VFV/VFV010c | INDICATOR=P11_P12_P131, ContentsCode=VFV010c1 | M EUR | Government revenue
gov_debt | /VEK/VF/VFV/VFV020c | INDICATOR=TOTAL, SECTOR=S13, ContentsCode=VFV020c1 | M EUR | Government debt
exports | /TIR/AT/ATD/ATD110m | SESON=SCA, FLOW=EXP, COUNTRY_GROUP=TOTAL, ContentsCode=ATD110m | M EUR | Exports (seasonally adjusted)
imports | /TIR/AT/ATD/ATD110m | SESON=SCA, FLOW=IMP, COUNTRY_GROUP=TOTAL, ContentsCode=ATD110m | M EUR | Imports (seasonally adjusted)
biz_confidence | /VEK/KR/KRE/KRE010m | ContentsCode=KRE010m | index | Economic sentiment
construction_output | /NOZ/BU/BUP/BUP010c | NACE=F, ContentsCode=BUP010c | index | Construction output
new_vehicles | /NOZ/TR/TRC/TRC010c | VEHICLE=CAR, INDICATOR=VEH_REG_1ST_NEW, ContentsCode=TRC010c | vehicles | New car registrations
wages_industry | /EMP/DS/DSV/DSV030 | GRS_NET=GRS, SECTOR=TOTAL, NACE=C, ContentsCode=DSV030 | EUR/month | Wages: manufacturing
wages_it | /EMP/DS/DSV/DSV030 | GRS_NET=GRS, SECTOR=TOTAL, NACE=J, ContentsCode=DSV030 | EUR/month | Wages: IT sector
energy_price_gas | /NOZ/EN/ENC/ENC020 | NG_CONS=4141902, INDICATOR=I_TAX, ContentsCode=ENC020 | EUR/GJ | Gas price (households)
building_permits | /NOZ/BU/BUE/BUP040c | BUILDING=TOTAL, SESON=SA, ContentsCode=BUP040c | index | New buildings started
renewable_share | /NOZ/EN/ENA/ENA010 | ContentsCode=ENA010 | % | Renewable energy share
ppi | /VEK/RC/RCI/RCI020m | SALES=TOVT, NACE_MIG=MIG_ING, ContentsCode=RCI020m2 | % YoY | Producer prices (PPI)
trade_balance | /TIR/AT/ATD/ATD110m | SESON=SCA, FLOW=BAL, COUNTRY_GROUP=TOTAL, ContentsCode=ATD110m | M EUR | Trade balance
"""

# fixed values: compared indicators: id | dataset | frequency | selections | unit | title
COMPARED = """
gdp | namq_10_gdp | Q | unit=CLV_PCH_PRE, s_adj=SCA, na_item=B1GQ | % QoQ | GDP Growth Rate
unemployment | une_rt_m | M | unit=PC_ACT, s_adj=SA, age=TOTAL, sex=T | % | Unemployment Rate
inflation | prc_hicp_manr | M | coicop=CP00 | % YoY | HICP Inflation
house_prices | prc_hpi_q | Q | purchase=TOTAL, unit=RCH_A | % YoY | House Price Change
interest_rate | irt_lt_mcby_m | M |  | % | Long-term interest rate
gov_debt_gdp | gov_10dd_edpt1 | A | na_item=GD, unit=PC_GDP | % GDP | Government debt / GDP
construction | sts_copr_m | M | nace_r2=F, s_adj=SCA, unit=PCH_SM | % MoM | Construction output
consumer_confidence | ei_bsco_m | M | indic=BS-CSMCI-BAL, s_adj=SA | balance | Consumer confidence
salary | lc_lci_lev | A | lcstruct=D1_D4_MD5, unit=EUR, nace_r2=B-S_X_O | EUR/hour | Hourly labour cost
retail | sts_trtu_m | M | nace_r2=G47, s_adj=CA, unit=PCH_SM | % MoM | Retail sales growth
population | demo_pjan | A | sex=T, age=TOTAL | persons | Population
tourism | tour_occ_nim | M | nace_r2=I551-I553, unit=NR, c_resid=TOTAL | persons | Tourist arrivals
industrial | sts_inpr_m | M | nace_r2=B-D36, s_adj=SCA, unit=PCH_PRE | % MoM | Industrial production
ppi | sts_inpp_m | M | nace_r2=B-D, s_adj=NSA, unit=PCH_PRE | % MoM | Producer prices
gov_revenue | gov_10q_ggnfa | Q | na_item=TR, unit=MIO_EUR, sector=S13 | M EUR | Government revenue
exports | ext_tec01 | M | stk_flow=EXP, partner=WORLD, unit=MIO_EUR | M EUR | Exports
imports | ext_tec01 | M | stk_flow=IMP, partner=WORLD, unit=MIO_EUR | M EUR | Imports
vehicles | road_eqs_carhab | A |  | per 1000 | Passenger cars per 1000 inhabitants
renewables | nrg_ind_ren | A | nrg_bal=REN | % | Renewable energy share
wages_mfg | lc_lci_r2_q | Q | nace_r2=C, unit=I20, s_adj=SCA | index (2020=100) | Labour cost: manufacturing
wages_it | lc_lci_r2_q | Q | nace_r2=J, unit=I20, s_adj=SCA | index (2020=100) | Labour cost: IT sector
job_vacancy | jvs_q_nace2 | Q | nace_r2=B-S, s_adj=SA, sizeclas=TOTAL, indic_em=JOBRATE | % | Job vacancy rate
current_account | bop_c6_q | Q | bop_item=CA, stk_flow=BAL, partner=WRL_REST, currency=MIO_EUR, sectpart=S1 | M EUR | Current account balance
elec_production | nrg_cb_em | M | siec=TOTAL, nrg_bal=GEP | GWh | Electricity production
gdp_per_capita | sdg_08_10 | A | unit=CLV10_EUR_HAB | EUR | GDP per capita
inequality | tipsii20 | A |  | index | Income inequality (Gini)
youth_unemployment | une_rt_m | M | unit=PC_ACT, s_adj=SA, age=Y_LT25, sex=T | % | Youth unemployment (under 25)
trade_balance | bop_c6_q | Q | bop_item=GS, stk_flow=BAL, partner=WRL_REST, currency=MIO_EUR, sectpart=S1, sector10=S1 | M EUR | Trade balance (goods & services)
gov_deficit | gov_10q_ggnfa | Q | na_item=B9, unit=MIO_EUR, sector=S13 | M EUR | Government net lending/borrowing
life_expectancy | demo_mlexpec | A | sex=T, age=Y1 | years | Life expectancy at birth
elec_price_household | nrg_pc_204 | S | nrg_cons=TOT_KWH, tax=I_TAX, currency=EUR | EUR/kWh | Electricity price (households)
"""

# fixed values: chapters of the Harmonized System
CARGO = """
02 | Meat
03 | Fish & Seafood
04 | Dairy, Eggs, Honey
07 | Edible Vegetables
08 | Edible Fruit & Nuts
09 | Coffee, Tea, Spices
10 | Cereals
11 | Milling Products
15 | Animal/Vegetable Fats
16 | Meat & Fish Preparations
19 | Cereal Preparations
20 | Vegetable Preparations
22 | Beverages & Spirits
23 | Food Residues & Animal Feed
25 | Salt, Sulphur, Stone, Cement
27 | Mineral Fuels & Oils
28 | Inorganic Chemicals
29 | Organic Chemicals
30 | Pharmaceutical Products
31 | Fertilizers
33 | Essential Oils & Cosmetics
34 | Soap & Surface Agents
35 | Glues & Enzymes
38 | Misc. Chemical Products
39 | Plastics & Plastic Articles
44 | Wood & Wood Articles
46 | Woven Vegetable Materials
48 | Paper & Paperboard
49 | Printed Materials
52 | Cotton
54 | Man-made Filaments
56 | Wadding, Felt, Nonwovens
57 | Carpets & Textile Flooring
61 | Knitted Apparel
68 | Stone, Plaster, Cement Articles
69 | Ceramic Products
70 | Glass & Glassware
71 | Precious Stones & Metals
72 | Iron & Steel
73 | Iron/Steel Articles
84 | Machinery & Equipment
85 | Electrical Equipment
94 | Furniture & Lighting
95 | Toys & Games
96 | Misc. Manufactured Articles
99 | Special Classification
N/A | Unclassified Cargo
"""

# fixed values: national indicator | compared indicator that stands in for other countries
STAND_IN = """
gdp | gdp
unemployment | unemployment
cpi | inflation
house_prices | house_prices
salary | salary
retail_sales | retail
population | population
tourist_arrivals | tourism
hotel_occupancy | tourism
construction_output | construction
biz_confidence | consumer_confidence
industrial | industrial
ppi | ppi
gov_revenue | gov_revenue
gov_debt | gov_debt_gdp
exports | exports
imports | imports
new_vehicles | vehicles
renewable_share | renewables
wages_industry | wages_mfg
wages_it | wages_it
trade_balance | trade_balance
"""

# fixed values: indicator | related indicators
RELATED = """
gdp | salary unemployment industrial retail_sales
salary | gdp cpi unemployment
cpi | salary gdp house_prices
unemployment | gdp salary industrial
house_prices | cpi salary gdp
retail_sales | cpi salary gdp
industrial | gdp retail_sales unemployment
population | unemployment salary gdp
exports | imports gdp industrial
imports | exports gdp retail_sales
hotel_occupancy | tourist_arrivals gdp
tourist_arrivals | hotel_occupancy gdp
gov_revenue | gov_debt gdp cpi
gov_debt | gov_revenue gdp
biz_confidence | gdp retail_sales unemployment
construction_output | building_permits gdp house_prices
building_permits | construction_output house_prices
new_vehicles | retail_sales salary biz_confidence
wages_industry | salary wages_it industrial
wages_it | salary wages_industry
energy_price_gas | cpi renewable_share
renewable_share | energy_price_gas
ppi | cpi industrial exports
trade_balance | exports imports gdp
"""

# fixed values: ports (code, name, latitude, longitude)
PORTS = [("LVRIX", "Riga", 57.05, 24.10), ("LVVNT", "Ventspils", 57.40, 21.55), ("LVLPX", "Liepāja", 56.52, 20.97)]

# fixed values: currencies
CURRENCIES = [
    ("USD", "US Dollar"), ("GBP", "British Pound"), ("PLN", "Polish Zloty"), ("SEK", "Swedish Krona"), ("NOK", "Norwegian Krone"),
    ("CHF", "Swiss Franc"), ("JPY", "Japanese Yen"), ("CZK", "Czech Koruna"), ("DKK", "Danish Krone"),
]

# fixed values: cities (country, name, latitude, longitude); the first of a country is its capital
CITIES = [
    ("lv", "Riga", 56.95, 24.11), ("lv", "Liepāja", 56.51, 21.01), ("lv", "Daugavpils", 55.87, 26.53), ("lv", "Jūrmala", 56.97, 23.77),
    ("ee", "Tallinn", 59.44, 24.75), ("ee", "Tartu", 58.38, 26.72), ("ee", "Pärnu", 58.39, 24.50), ("ee", "Narva", 59.38, 28.19),
    ("lt", "Vilnius", 54.69, 25.28), ("lt", "Kaunas", 54.90, 23.89), ("lt", "Klaipėda", 55.71, 21.13), ("lt", "Šiauliai", 55.93, 23.31),
]

# fixed values: people in a capital where no count can be had
POPULATION = {"lv": 605802, "ee": 456000, "lt": 590000}
COUNTRIES = {"lv": "LV", "ee": "EE", "lt": "LT"}

# fixed values: what an unknown country stands for, and time zones
DEFAULT_COUNTRY = "lv"
ZONES = {"lv": "Europe/Riga", "ee": "Europe/Tallinn", "lt": "Europe/Vilnius"}

# fixed values: label and emoji of an insight's level
BADGES = [("routine", "Routine", "🟢"), ("notable", "Notable", "🟡"), ("significant", "Significant", "🔴")]

# fixed values: icons of weather descriptions; any other
ICONS = [
    ("Clear sky", "☀️"), ("Partly cloudy", "⛅"), ("Overcast", "☁️"), ("Foggy", "🌫️"), ("Drizzle", "🌦️"), ("Rain", "🌧️"), ("Snow", "❄️"),
    ("Rain showers", "🌧️"), ("Snow showers", "🌨️"), ("Thunderstorm", "⛈️"),
]
OTHER_ICON = "🌡️"

# fixed values: colours of air quality; any other status is shown as the first
AIR_COLOURS = [("good", "emerald"), ("moderate", "yellow"), ("unhealthy", "red")]

# fixed values: sources whose health is probed (name, kind, required)
PROBES = [
    ("ECB Exchange Rates", "xml", True), ("NordPool Electricity", "json", True), ("data.gov.lv CKAN", "json", True), ("CSP PxWeb", "pxweb", True),
    ("Open-Meteo Weather", "json", True), ("Open-Meteo Air Quality", "json", True), ("Riga Open Data", "json", False),
]


class UnknownIndicatorError(KeyError):
    """No such indicator."""


class QueryTooShortError(ValueError):
    """A search needs three characters at least."""


def _rows(text: str) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")] for line in text.strip().splitlines()]


def _pairs(text: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in text.split(", ") if p)


def _frame(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def national(spark: SparkSession) -> DataFrame:
    rows = [(i, path, _pairs(s), unit, title) for i, path, s, unit, title in ((r[0], r[1], r[2], r[3], r[4]) for r in _rows(NATIONAL))]
    return _frame(spark, rows, "id string, path string, selections map<string, string>, unit string, title string")


def compared(spark: SparkSession) -> DataFrame:
    rows = [(r[0], r[1], r[2], _pairs(r[3]), r[4], r[5]) for r in _rows(COMPARED)]
    return _frame(spark, rows, "id string, dataset string, freq string, selections map<string, string>, unit string, title string")


def cargo(spark: SparkSession) -> DataFrame:
    return _frame(spark, map(tuple, _rows(CARGO)), "code string, name string")


def stand_ins(spark: SparkSession) -> DataFrame:
    return _frame(spark, map(tuple, _rows(STAND_IN)), "id string, source string")


def related(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(r[0], r[1].split()) for r in _rows(RELATED)], "id string, related array<string>")


def ports(spark: SparkSession) -> DataFrame:
    return _frame(spark, PORTS, "code string, name string, lat double, lon double")


def currencies(spark: SparkSession) -> DataFrame:
    return _frame(spark, CURRENCIES, "currency string, name string")


def cities(spark: SparkSession) -> DataFrame:
    return _frame(spark, CITIES, "country string, city string, lat double, lon double")


def capitals(spark: SparkSession) -> DataFrame:
    """The first city of each country, with its time zone."""
    first = {country: (country, city, lat, lon, ZONES[country]) for country, city, lat, lon in reversed(CITIES)}
    return _frame(spark, first.values(), "country string, city string, lat double, lon double, zone string")


def badges(spark: SparkSession) -> DataFrame:
    return _frame(spark, BADGES, "level string, label string, emoji string")


def icons(spark: SparkSession) -> DataFrame:
    return _frame(spark, ICONS, "description string, icon string")


def air_colours(spark: SparkSession) -> DataFrame:
    return _frame(spark, AIR_COLOURS, "status string, colour string")


def lookup(spark: SparkSession, indicator: str, which: str = "national"):
    """The catalogue row of an indicator."""
    found = {"national": national, "compared": compared}[which](spark).where(f"id = '{indicator}'").first() if indicator.isidentifier() else None
    if found is None:
        raise UnknownIndicatorError(indicator)
    return found


def checked_query(text: str | None) -> str:
    if len(text or "") < 3:
        raise QueryTooShortError(text)
    return text
