"""Seeded case tables: the same number of cases and seed gives the same rows, row by row.

A table is a list of columns, each an SQL expression of ``seq`` (the case), ``k`` (the row in the
case) and a few columns of the case. ``pick`` and ``num`` draw from a hash of seed, case, row and
column, so any partitioning gives the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewell.functions.values import OFFENCES

#: Names, places and things that cases are made of.
NAMES = {"Male": ("Amit", "Rahul", "Suresh", "Vikram", "Imran", "Arjun"), "Female": ("Priya", "Neha", "Sunita", "Anjali", "Fatima", "Kavita")}
LAST = ("Sharma", "Patil", "Khan", "Deshmukh", "Joshi", "Naik")
ALIASES = ("The Don", "Dang", "Cheena", "Singh", "Gogo", "Pathan")
DISTRICTS = ("Thane", "Panvel", "Kalyan", "Vashi", "Dadar", "Andheri", "Nerul", "Airoli")
CARS = ("White Maruti Swift", "Black Hyundai Creta", "Grey Tata Nexon", "Red Honda City")
PLAZAS = ("TP-0102 / Vashi Toll Plaza", "TP-0105 / Khalapur Toll Plaza", "TP-0108 / Urse Toll Plaza", "TP-0210 / Khed Toll Plaza")
CORRIDORS = ("Mumbai-Panvel", "Mumbai-Pune Expressway", "Mumbai-Pune Expressway", "NH-48 (Pune-Satara)")
CAMERAS = ("ANPR-MH04-VSH / Vashi Bridge, Mumbai", "ANPR-MPE-KHL / Khalapur Km 42", "ANPR-MPE-URS / Urse Toll Km 84", "ANPR-NH48-KHD / Khed Plaza Km 120")
GPS = ("19.0596 N, 72.9011 E", "18.8021 N, 73.2104 E", "18.7112 N, 73.6102 E", "18.3512 N, 73.8901 E")
TIERS = ("NONE", "BASIC", "MODERATE", "COMPLEX")
SEED = 2026


def draw(salt: str, m: int) -> str:
    return f"pmod(xxhash64({SEED}, seq, k, '{salt}'), {m})"


def num(salt: str, low: int, high: int) -> str:
    return f"({low} + {draw(salt, high - low + 1)})"


def pick(salt: str, values: tuple) -> str:
    items = ", ".join("'" + str(v).replace("'", "\\'") + "'" for v in values)
    return f"element_at(array({items}), cast({draw(salt, len(values))} + 1 as int))"


def turn(index: str, values: tuple) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast(pmod({index}, {len(values)}) + 1 as int))"


def phone(salt: str) -> str:
    return f"concat('9', lpad(cast({draw(salt, 10**9)} as string), 9, '0'))"


def number_plate(salt: str) -> str:
    return f"concat('MH', lpad(cast({num(salt + 'r', 1, 48)} as string), 2, '0'), '-', char(65 + {draw(salt + 'a', 26)}), char(65 + {draw(salt + 'b', 26)}), '-', {num(salt, 1000, 9999)})"


def code(prefix: str, salt: str, digits: int) -> str:
    return f"concat('{prefix}', lpad(cast({draw(salt, 10**digits)} as string), {digits}, '0'))"


def when(layout: str, minutes: str) -> str:
    return f"date_format(timestamp_ntz'2026-09-01 08:00:00' + make_interval(0, 0, 0, cast(pmod(seq, 28) as int), 0, cast({minutes} as int), 0), '{layout}')"


STAMP, SHORT, CALL = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm"
CASE_KEY = "FIR_No"


def case_draw(salt: str, m: int) -> str:
    """Like ``draw``, but the same for all rows of a case."""
    return f"pmod(xxhash64({SEED}, seq, 0, '{salt}'), {m})"


def connectivity(category: Column, section: Column, district: Column, places: Column) -> Column:
    """Planned if organized or cyber, if the section text has 111 anywhere, or if a place that is
    named differs from the district."""
    plain = lambda c: F.lower(F.trim(c))
    elsewhere = F.coalesce(F.exists(places, lambda p: p.isNotNull() & (F.trim(p) != "") & (plain(p) != plain(district))), F.lit(False))
    return F.when(category.isin("Organized", "Cyber") | section.contains("111") | elsewhere, "Planed").otherwise("Unplaned")


#: Percentages of the tiers, for financial kinds of cases that are planned or not, and
#: for others that are planned or not.
TIER_WEIGHTS = {(True, True): (5, 10, 20, 65), (True, False): (15, 25, 35, 25), (False, True): (35, 30, 25, 10), (False, False): (75, 20, 5, 0)}
_MONEY = "Case_Type in (" + ", ".join(f"'{o[0]}'" for o in OFFENCES if o[2] in ("Organized", "Financial", "Cyber")) + ")"


def _tier() -> str:
    """A seeded number against cumulative weights."""
    u, cases_ = case_draw("tier", 100), []
    for (money, planned), w in TIER_WEIGHTS.items():
        steps = " ".join(f"when {u} < {sum(w[: i + 1])} then '{t}'" for i, t in enumerate(TIERS[:-1]))
        cases_.append(f"when {'' if money else 'not '}({_MONEY}) and {'' if planned else 'not '}(Connectivity_Type = 'Planed') then case {steps} else '{TIERS[-1]}' end")
    return "case " + " ".join(cases_) + " end"


def cases(spark: SparkSession, n: int = 20, first: int = 1) -> DataFrame:
    """The case table of ``n`` cases numbered from ``first`` and, beside its 60 columns, ``seq``."""
    return cases_of(spark.range(first, first + n).select(F.col("id").alias("seq")))


def cases_of(numbers: DataFrame) -> DataFrame:
    """A case for each number ``seq``, which seeds all that is drawn: as many as the table has rows."""
    base = numbers.select(F.col("seq").cast("long").alias("seq"), F.lit(0).alias("k"))
    crime = pick("crime", tuple(o[0] for o in OFFENCES))
    lookup = lambda j: F.element_at(F.create_map(*[F.lit(x) for o in OFFENCES for x in (o[0], o[j])]), F.col("Case_Type"))
    person = lambda s, g: f"concat({pick(s + 'f', NAMES[g])}, ' ', {pick(s + 'l', LAST)})"
    vehicle = lambda s: f"if({draw(s + 'has', 100)} < 85, concat({number_plate(s)}, ' (', {pick(s + 'car', CARS)}, ')'), 'N/A')"
    rows = base.withColumn("Case_Type", F.expr(crime)).withColumns({"__section": lookup(1), "__category": lookup(2)})
    columns = {
        "District": pick("district", DISTRICTS), "Police_Station": f"concat({pick('district', DISTRICTS)}, ' PS')", "State_UT": "'Maharashtra'",
        "FIR_No": "format_string('FIR/2026/%04d', seq)", "Year": "2026L", "Date_Time_of_FIR": when(SHORT, "seq * 7"), "Acts_Sections": "__section", "Case_Type": "Case_Type",
        "Connectivity_Type": "''", "Vulnerability_Category": "''", "Days_Offset_N": num("offset", 0, 5),
        "Day_of_Occurrence": when("EEEE", "0"), "Occurrence_Date_Range": f"concat({when('yyyy-MM-dd', '0')}, ' to ', {when('yyyy-MM-dd', '1440')})",
        "Time_Period_Shift": pick("shift", ("Morning", "Afternoon", "Night")), "GD_Reference_Entry_No": code("GD-", "gd", 5), "Type_of_Information": pick("info", ("Written", "Oral")),
        "Direction_Distance_from_PS": pick("dist", ("North, 2 km", "South, 5 km", "East, 1 km")), "Beat_No": code("B", "beat", 2), "Place_of_Occurrence": pick("place", DISTRICTS),
        "Outside_Jurisdiction_PS": "'N/A'", "Informant_Name": person("inf", "Female"), "Informant_Father_Husband": person("inff", "Male"), "Informant_Age": num("infage", 18, 75),
        "Informant_Gender": "'Female'", "Informant_Nationality": "'Indian'", "Informant_Passport_No": code("Z", "pass", 7), "Informant_Aadhaar": "'[Aadhaar Redacted]'",
        "Informant_Occupation": pick("occ", ("Business", "Service", "Student")), "Informant_Address": pick("infaddr", DISTRICTS), "Informant_Contact": phone("inf"),
        "Informant_Vehicles": vehicle("infv"), "Victim_Name": person("vic", "Male"), "Victim_Age": num("vicage", 10, 80), "Victim_Gender": "'Male'", "Victim_Contact": phone("vic"),
        "Victim_Aadhaar": "'[Aadhaar Redacted]'", "Victim_Vehicles": vehicle("vicv"), "Accused_Status": pick("known", ("Known", "Unknown")), "Number_of_Accused": num("nacc", 1, 4),
        "Accused_Name_Alias": f"concat({pick('accf', NAMES['Male'])}, ' ', {pick('accl', ALIASES)})", "Accused_Contact": phone("acc"), "Accused_Address": pick("accaddr", DISTRICTS),
        "Accused_Build": pick("build", ("Slim", "Medium", "Heavy")), "Accused_Height_cm": num("height", 150, 190), "Accused_Complexion": pick("compl", ("Fair", "Dark")),
        "Accused_Distinctive_Marks": pick("marks", ("Scar", "Tattoo", "None")), "Accused_Vehicles": vehicle("accv"), "Accused_Vehicle_Identified_Probability": f"{draw('prob', 100)} / 100.0D",
        "Reasons_for_Delay": pick("delay", ("Threatened by accused", "None / Immediate Reporting")), "Inquest_UD_Case_No": "'N/A'", "Property_Category_Type": pick("prop", ("Cash", "Laptops", "Motor Vehicle")),
        "Property_Description_Serial_No": code("SN", "serial", 8), "Total_Property_Value_INR": num("value", 1000, 500000), "FIR_Narrative_Statement": "concat('Complaint of ', Case_Type, '.')",
        "Action_Taken": "'Registered'", "Investigating_Officer_Name": person("io", "Male"), "IO_Badge_No": code("IO", "badge", 4), "Complainant_Sign_Acknowledged": "'YES'",
        "Free_Copy_Delivered": "'YES'", "Date_Time_Dispatch_to_Court": when(SHORT, "seq * 7 + 120"),
    }
    from casewell.functions.values import vulnerability

    out = rows.select("seq", "__category", *[F.expr(e).alias(c) for c, e in columns.items()])
    out = out.withColumn("Connectivity_Type", connectivity(F.col("__category"), F.col("Acts_Sections"), F.col("District"), F.array("Place_of_Occurrence")))
    return out.withColumn("Vulnerability_Category", vulnerability(F.col("Victim_Age"), F.col("Victim_Gender"), F.col("Case_Type"))).drop("__category")


ROLE = turn("k", ("Informant", "Victim", "Accused"))
ROLE_NAME = "element_at(array(Informant_Name, Victim_Name, Accused_Name_Alias), cast(pmod(k, 3) + 1 as int))"
ROLE_PHONE = "element_at(array(Informant_Contact, Victim_Contact, Accused_Contact), cast(pmod(k, 3) + 1 as int))"
PLATE = f"concat('MH04-', char(65 + cast(pmod(k, 3) as int)), 'X-', 1000 + pmod(seq * 7 + pmod(k, 3), 9000))"
FLAGGED = "(k = rows_in_case - 1 and pmod(seq, 2) = 0)"
TIER = f"({_tier()})"
#: The role that calls and vehicles flag, and the one that money flags: the same in 70 of 100 cases.
FLAGGED_ROLE = "pmod(seq, 3)"
MONEY_ROLE = f"if({case_draw('mule', 100)} < 70, {FLAGGED_ROLE}, pmod(seq + 1 + {case_draw('other', 2)}, 3))"
SUSPECT = f"element_at(array(Informant_Name, Victim_Name, Accused_Name_Alias), cast({MONEY_ROLE} + 1 as int))"
ACCOUNT = "concat('XXXX', lpad(cast(pmod(seq * 37, 10000) as string), 4, '0'))"
SUBJECT = "Victim_Name"

#: Table to rows per case (an SQL expression of the case) and columns.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "Subscriber_Detail_Records": ("3", {"Mobile Number": ROLE_PHONE, "Subscriber Name": ROLE_NAME, "Father/Husband Name": pick("sdrf", LAST), "Local Address": pick("loc", DISTRICTS), "Permanent Address": pick("perm", DISTRICTS), "Proof of Identity (PoI)": "'Aadhaar'", "Proof of Address (PoA)": "'Utility bill'", "Activation Date & Time": when(SHORT, "k"), "Service Provider / Circle": pick("isp", ("Jio / Mumbai", "Airtel / Mumbai")), "IMSI Number": code("4049", "imsi", 11), "SIM Card ID (ICCID)": code("8991", "iccid", 15), "Alternate Contact No.": phone("alt")}),
    "Call_Recording": ("50", {"Calling Number (A-Party)": ROLE_PHONE, "Called Number (B-Party)": f"if(k = 49, Accused_Contact, {phone('b')})", "Call Date & Time": when(CALL, "k * 15"), "Type": pick("ctype", ("Voice", "SMS")), "Duration (s)": num("dur", 3, 900), "IMEI": code("35", "imei", 13), "IMSI Number": code("4049", "imsi", 11), "Start Cell ID": code("C", "cell1", 5), "End Cell ID": code("C", "cell2", 5), "First Tower Location": turn("k", DISTRICTS), "Last Tower Location": turn("k + 1", DISTRICTS)}),
    "IP_Detail_Records": ("30", {"Session Start Time": when("dd/MM/yyyy HH:mm:ss", "k * 10"), "Session End Time": when("dd/MM/yyyy HH:mm:ss", "k * 10 + 8"), "Allocated Private IP": "concat('10.0.0.', k)", "Private Port": num("pp", 1024, 65000), "Source Public IP": f"concat('49.36.1.', {num('ip', 1, 254)})", "Public Port": num("pub", 1024, 65000), "Destination IP": f"concat('142.250.1.', {num('dip', 1, 254)})", "Protocol": pick("proto", ("TCP", "UDP")), "Destination Port": "443L", "Volume In (Bytes)": num("vin", 100, 10**6), "Volume Out (Bytes)": num("vout", 100, 10**6), "RAT Type": pick("rat", ("4G", "5G"))}),
    "Vehicle_Summary": ("3", {"Person_Role": ROLE, "Person_Name": ROLE_NAME, "Has_Vehicle": "'YES'", "Plate": PLATE, "FASTag_ID": "concat('TAG', seq, '-', k)", "VAHAN_Status": "'ACTIVE'"}),
    "VAHAN_Database": ("3", {"Registration Number": PLATE, "Owner Name": ROLE_NAME, "Vehicle Class": "'Motor Car (LMV)'", "Maker / Model": pick("car", CARS), "Chassis Number": code("MA3A", "ch", 10), "Engine Number": code("ENG", "en", 7), "Fuel Type": "'PETROL/BS-VI'", "Linked Mobile": ROLE_PHONE, "Vehicle Status": "'ACTIVE'"}),
    "SARATHI_Database": ("3", {"Role": ROLE, "Driving License No": code("MH04", "dl", 11), "License Holder": ROLE_NAME, "Father/Husband Name": pick("dlf", LAST), "Issuing RTO": "'MH04'", "Class of Vehicle": "'LMV'", "Linked Mobile": f"if(pmod(seq + k, 5) = 0, {phone('dl')}, {ROLE_PHONE})", "License Status": "'VALID'"}),
    "FASTag_Toll_Logs": ("9", {"Person_Role": ROLE, "Timestamp (IST)": when(STAMP, "floor(k / 3) * 45"), "Toll Plaza ID & Location": turn("floor(k / 3)", PLAZAS), "Corridor": turn("floor(k / 3)", CORRIDORS), "Vehicle Registration": PLATE, "FASTag Tag ID": "concat('TAG', seq, '-', pmod(k, 3))", "Toll Fee (INR)": "110L", "ANPR Cross-Match": f"if({FLAGGED}, 'MISMATCH', 'MATCH')", "Txn Status": f"if({FLAGGED}, 'FLAG_ALERT', 'SUCCESS')"}),
    "ANPR_Camera_Feeds": ("9", {"Person_Role": ROLE, "Detection Time": when(STAMP, "floor(k / 3) * 45"), "Camera ID & Location": turn("floor(k / 3)", CAMERAS), "GPS Coordinates": turn("floor(k / 3)", GPS), "Captured Plate": f"if({FLAGGED}, 'MH99-ZZ-0001', {PLATE})", "OCR Confidence": f"concat({num('ocr', 95, 99)}, '.5%')", "Vehicle Color & Class": pick("car", CARS), "VAHAN Match": f"if({FLAGGED}, 'MISMATCH_SUSPECT', 'MATCH')", "Investigation Flag": f"if({FLAGGED}, 'RULE 1: FASTAG / ANPR PLATE MISMATCH', 'PASS')"}),
    "Financial_Summary": ("1", {"Financial_Tier": TIER, "Flagged_Person": SUSPECT, "Linked_Account": ACCOUNT, "Linked_VPA": "concat(lower(split(Accused_Name_Alias, ' ')[0]), seq, '@upi')", "Crypto_Involved": f"if({TIER} = 'COMPLEX', 'YES', 'NO')", "Shell_Company_Involved": f"if({TIER} = 'COMPLEX', 'YES', 'NO')"}),
    "Bank_Statement_Records": (f"case {TIER} when 'NONE' then 0 when 'BASIC' then 3 when 'MODERATE' then 6 else 13 end", {"Person": f"concat({SUSPECT}, ' (', element_at(array('INFORMANT', 'VICTIM', 'ACCUSED'), cast({MONEY_ROLE} + 1 as int)), ')')", "Transaction_DateTime": when(STAMP, "if(k >= 10, 600 + k, k * 60)"), "UTR_Transaction_ID": code("UTR", "utr", 12), "Account_Number": ACCOUNT, "Type_CR_DR": "if(k >= 10 or pmod(k, 2) = 1, 'DR', 'CR')", "Amount_INR": f"if(k >= 10, {num('cash', 41000, 49000)}, {num('amt', 500, 90000)})", "Balance_INR": num("bal", 500, 200000), "Counterparty_Name": pick("cp", LAST), "Counterparty_Account_UPI": f"if(k >= 10, 'N/A', {code('XXXX', 'cpa', 4)})", "Channel": "if(k >= 10, 'ATM CASH', 'NEFT')"}),
    "UPI_Payment_Gateway_Logs": (f"case {TIER} when 'NONE' then 0 when 'BASIC' then 2 when 'MODERATE' then 4 else 8 end", {"Person": "Accused_Name_Alias", "Timestamp": when(STAMP, "if(k >= 6, 900 + (k - 6) * 7, k * 30)"), "Payer_VPA": "if(k = 7, 'mule@upi', 'payer@upi')", "Payee_VPA": "if(k = 7, 'exit@upi', 'mule@upi')", "RRN_Transaction_Ref": code("", "rrn", 12), "Device_ID_IMEI": code("35", "dev", 13), "IP_Address": f"concat('49.36.2.', {num('upi', 1, 254)})", "Location_City": pick("city", DISTRICTS), "Status": "'SUCCESS'"}),
    "Merchant_Gateway_Transaction_Logs": (f"case {TIER} when 'MODERATE' then 3 when 'COMPLEX' then 5 else 0 end", {"Person": "Accused_Name_Alias", "Timestamp": when(STAMP, "k * 40"), "Merchant_Name": pick("mer", ("Kirana", "Electro World")), "Gateway": pick("gw", ("PG-1", "PG-2")), "Gateway_Txn_ID": code("GTX", "gtx", 10), "Payment_Mode": pick("mode", ("CARD", "NETBANKING")), "Amount_INR": num("mamt", 100, 50000), "Device_Fingerprint": code("FP", "fp", 8), "IP_Address": "if(k = 0, '185.220.101.1', '49.36.3.1')", "IP_Geolocation": "if(k = 0, 'Proxy', 'Mumbai')", "Risk_Score": num("risk", 1, 99), "Gateway_Response": "'OK'", "Txn_Status": "'SUCCESS'"}),
    "Crypto_OnChain_Transactions": (f"if({TIER} = 'COMPLEX', 1, 0)", {"Blockchain": "'TRON'", "TxHash": "concat('0x', md5(concat('tx', seq)))", "Sender_Wallet": "concat('T', md5(concat('s', seq)))", "Receiver_Wallet": "concat('T', md5(concat('r', seq)))", "Asset": "'USDT'", "Amount": num("usdt", 100, 9000), "Timestamp": when(STAMP, "300"), "Status": "'CONFIRMED'", "Attribution": "'Unhosted'"}),
    "Crypto_Exchange_KYC_Records": (f"if({TIER} = 'COMPLEX', 1, 0)", {"Exchange_Name": "'CoinDesk IN'", "FIU_ID": code("FIU", "fiu", 5), "Account_UID": "concat('UID', seq)", "Registered_Name": "Accused_Name_Alias", "KYC_Status": "'VERIFIED'", "PAN": code("ABCPK", "pan", 4), "Registered_Mobile": "Accused_Contact", "Linked_Bank_Account": ACCOUNT, "Primary_Deposit_Wallet": "concat('T', md5(concat('r', seq)))", "Registration_IP": "'49.36.4.1'"}),
    "Crypto_Exchange_OnOffRamp_Logs": (f"if({TIER} = 'COMPLEX', 2, 0)", {"Timestamp": when(STAMP, "310 + k * 50"), "Account_UID": "concat('UID', seq)", "Type": "if(k = 0, 'CRYPTO_DEPOSIT', 'FIAT_PAYOUT')", "Asset": "if(k = 0, 'USDT', 'INR')", "Amount": num("ramp", 100, 9000), "Channel": "if(k = 0, 'ON-CHAIN', 'IMPS')", "Linked_Ref": "concat('REF', seq)", "Status": "'COMPLETED'"}),
    "ITR_Forensic_Profile": (f"if({TIER} = 'COMPLEX', 1, 0)", {"Assessee_Name": "Accused_Name_Alias", "PAN": code("ABCPK", "pan", 4), "Assessment_Year": "'2026-27'", "ITR_Form": "'ITR-1'", "Gross_Total_Income_INR": num("income", 100000, 400000), "High_Value_SFT_Txns_INR": num("sft", 1000000, 9000000), "Income_to_SFT_Ratio": f"round({num('sft', 1000000, 9000000)} / {num('income', 100000, 400000)}, 2)", "ITD_Risk_Rating": "'HIGH'"}),
    "GST_EWayBill_Records": (f"if({TIER} = 'COMPLEX', 1, 0)", {"Supplier_GSTIN": code("27", "gst1", 13), "Supplier_Name": "'Alpha Traders'", "Recipient_GSTIN": code("27", "gst2", 13), "Recipient_Name": "'Beta Impex'", "Commodity_HSN": "'8517'", "Taxable_Value_INR": num("tax", 100000, 9000000), "Vehicle_No": PLATE, "Route_Distance_KM": num("km", 10, 900), "Forensic_Flag": "if(pmod(seq, 8) = 3, 'FAKE_EWAY_BILL', 'CLEAN')"}),
    "CIBIL_Commercial_Credit_Report": (f"if({TIER} = 'COMPLEX', 1, 0)", {"Entity_Name": "'Alpha Traders'", "CIBIL_Rank_CMR": "concat('CMR-', 1 + pmod(seq, 10))", "Credit_Institution": "'State Bank'", "Sanctioned_Limit_INR": num("limit", 100000, 9000000), "Overdue_Amount_INR": num("over", 0, 900000), "Defaulter_Status": pick("def", ("NO", "WILFUL DEFAULTER"))}),
    "RoC_Shell_Company_Filings": (f"if({TIER} = 'COMPLEX', 1, 0)", {"CIN": code("U51", "cin", 18), "Company_Name": "concat('Shell ', seq, ' Pvt Ltd')", "Registered_Office_Address": pick("office", ("Flat 1, Nariman Point", "Shop 9, Vashi")), "Director_DIN": code("", "din", 8), "Director_Name": "Accused_Name_Alias", "Total_Directorships_Held": num("dirs", 2, 20), "Declared_Annual_Income_INR": num("declared", 50000, 400000), "MCA_Status": "'ACTIVE'", "Revenue_FY1_INR": num("fy1", 0, 9000000), "Revenue_FY2_INR": num("fy2", 0, 9000000), "Statutory_Auditor": "'A & Co'"}),
}
_EXAM = {"Subject_Name": SUBJECT, "Subject_Status": "'Alive'", "Subject_Role": "'Victim'", "Patient_Name": SUBJECT, "Patient_Contact": "Victim_Contact", "Deceased_Name_or_ID": SUBJECT, "Age": "Victim_Age", "Gender": "Victim_Gender", "Age_Gender": "concat(Victim_Age, ' / ', Victim_Gender)", "Exam_Date_Time": when(SHORT, "200"), "Estimated_Time_of_Death": when(SHORT, "100")}
_VIOLENT, _SEXUAL, _FATAL = "Case_Type in ('Attempt to Murder', 'Grievous Hurt', 'Acid Attack', 'Robbery', 'Dacoity', 'Rape')", "Case_Type in ('Rape', 'Sexual Harassment')", "Case_Type in ('Murder', 'Dowry Death', 'Mob Lynching')"
#: Medical tables: when a case has one, and its columns.
MEDICAL = {
    "MLC_Clinical_Assault_Reports": (_VIOLENT, "MLC_Case_Number Examining_Facility Examining_Medical_Officer Requisitioning_Police_Station Patient_Name Patient_Contact Age Gender Exam_Date_Time Informed_Consent History_of_Incident External_Injuries Age_of_Injuries Legal_Classification Toxicology_Check Medical_Action_Taken"),
    "PostMortem_Autopsy_Reports": (_FATAL, "Autopsy_Report_Number Mortuary_Hospital Lead_Pathologist Inquest_Authority Deceased_Name_or_ID Identification_Status Estimated_Age_Sex Estimated_Time_of_Death Rigor_Mortis_Lividity External_Findings Internal_Findings Preserved_Evidence Cause_of_Death"),
    "Forensic_Toxicology_Reports": (_FATAL, "Toxicology_Lab_Ref Testing_Laboratory Requesting_Authority Subject_Name Age_Gender Specimens_Received Reporting_Expert Methodology Toxic_Agent_Identified Concentration_vs_Lethal_Threshold Toxicological_Conclusion"),
    "DNA_Profiling_Reports": (f"{_SEXUAL} or {_FATAL}", "DNA_Case_File_Number Testing_Laboratory Investigating_Unit Exhibits_Received Subject_Name Subject_Role Reporting_Expert STR_Loci_Analyzed DNA_Matching_Result Match_Probability Forensic_Verdict"),
    "SAFE_Reports": (_SEXUAL, "SAFE_Case_Number Examining_Center Examining_Doctor Patient_Name Age_Gender Time_Elapsed_Post_Incident Extragenital_Injuries Genital_Findings Evidence_Kit_Collected Biological_Screening Chain_of_Custody"),
    "Forensic_Odontology_Reports": (f"({_FATAL}) and pmod(seq, 3) = 0", "Odontology_Case_Ref Examining_Lab Subject_Identification_Status Dental_Charting_Match Conclusion"),
    "Skeletal_Identification_Reports": (f"({_FATAL}) and pmod(seq, 5) = 0", "Skeletal_Case_Ref Examining_Lab Estimated_Age_Range Biological_Sex Ancestry_Estimate Stature_Estimate_cm AnteMortem_Trauma Conclusion"),
    "Forensic_Psychiatric_Reports": (f"Accused_Status = 'Known' and {num('psy', 1, 100)} <= 12", "Evaluation_ID Evaluating_Board Subject_Name Subject_Status Referring_Legal_Body Purpose Mental_Status_Exam Psychometric_Testing Psychiatric_Verdict"),
}
for _name, (_has, _columns) in MEDICAL.items():
    TABLES[_name] = (f"if({_has}, 1, 0)", {c: _EXAM.get(c, f"concat('{c.replace('_', ' ')} ', {num(c, 100, 999)})") for c in _columns.split()})
TABLES["Medical_Forensic_Summary"] = ("1", {"Case_Type": "Case_Type", "Subject_Name": SUBJECT, "Reports_Generated": "coalesce(nullif(concat_ws('; ', " + ", ".join(f"if({has}, '{n}', null)" for n, (has, _) in MEDICAL.items()) + "), ''), 'NONE')"})


def child_table(case_rows: DataFrame, name: str) -> DataFrame:
    """Rows of one table for the given cases."""
    count, columns = TABLES[name]
    rows = case_rows.withColumn("k", F.lit(0)).withColumn("rows_in_case", F.expr(f"cast({count} as int)"))
    rows = rows.filter("rows_in_case > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("rows_in_case") - 1)))
    return rows.select(F.col(CASE_KEY).alias("Case_ID"), *[F.expr(e).alias(c) for c, e in columns.items()])


def all_tables(spark: SparkSession, n: int = 20, first: int = 1) -> dict[str, DataFrame]:
    c = cases(spark, n, first)
    return {"complete_fir_dataset": c.drop("seq")} | {t: child_table(c, t) for t in TABLES}


def write_all(spark: SparkSession, base: str, n: int = 20, first: int = 1, append: bool = False) -> list[str]:
    """Write every table that has rows; the names of those written."""
    from .tables import write_csv

    return [t for t, rows in all_tables(spark, n, first).items() if write_csv(rows, f"{base}/{t}.csv", append)]


def register_case(spark: SparkSession, base: str, given: dict | None = None) -> str:
    """One new case with the given values, and all its trails, appended to the tables; its number."""
    from .tables import read_table, write_csv

    seq = read_table(spark, base, "complete_fir_dataset").count() + 1
    known = {k: v for k, v in (given or {}).items() if k in COLUMNS["complete_fir_dataset"] and k != CASE_KEY}
    case = cases(spark, 1, seq)
    kinds = dict(case.dtypes)
    case = case.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in known.items()})
    write_csv(case.drop("seq"), f"{base}/complete_fir_dataset.csv", append=True)
    for t in TABLES:
        write_csv(child_table(case, t), f"{base}/{t}.csv", append=True)
    return case.first()[CASE_KEY]


_CASE_COLUMNS = (
    "District Police_Station State_UT FIR_No Year Date_Time_of_FIR Acts_Sections Case_Type Connectivity_Type Vulnerability_Category Days_Offset_N Day_of_Occurrence"
    " Occurrence_Date_Range Time_Period_Shift GD_Reference_Entry_No Type_of_Information Direction_Distance_from_PS Beat_No Place_of_Occurrence Outside_Jurisdiction_PS"
    " Informant_Name Informant_Father_Husband Informant_Age Informant_Gender Informant_Nationality Informant_Passport_No Informant_Aadhaar Informant_Occupation"
    " Informant_Address Informant_Contact Informant_Vehicles Victim_Name Victim_Age Victim_Gender Victim_Contact Victim_Aadhaar Victim_Vehicles Accused_Status"
    " Number_of_Accused Accused_Name_Alias Accused_Contact Accused_Address Accused_Build Accused_Height_cm Accused_Complexion Accused_Distinctive_Marks Accused_Vehicles"
    " Accused_Vehicle_Identified_Probability Reasons_for_Delay Inquest_UD_Case_No Property_Category_Type Property_Description_Serial_No Total_Property_Value_INR"
    " FIR_Narrative_Statement Action_Taken Investigating_Officer_Name IO_Badge_No Complainant_Sign_Acknowledged Free_Copy_Delivered Date_Time_Dispatch_to_Court"
).split()
COLUMNS = {"complete_fir_dataset": _CASE_COLUMNS} | {t: ["Case_ID", *c] for t, (_, c) in TABLES.items()}


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
