"""Fixed values that must equal the reference behaviour for equal results.

Everything in this module is data: regular expressions, keyword lists,
thresholds, message and recommendation texts, rule templates and validation
profiles.  They are written plainly, in their natural order, so that a reader
can check them against the documented behaviour line by line.  The code that
applies them lives in ``carecheck.operators``.

All regexes are Java regexes as used by Spark ``rlike``/``regexp_*``; the
``carecheck.functions.exprs.rx`` helper prefixes them with ``(?d)`` so that
``.``/``$`` only treat ``\\n`` as a line end, like Python ``re``.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: value-level PHI patterns of the PHI rule (V4), in order.
# --------------------------------------------------------------------------
PHI_VALUE_PATTERNS: dict[str, str] = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}-\d{3}-\d{4}\b",
    "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "zip_code": r"\b\d{5}(?:-\d{4})?\b",
}

# FIXED VALUES: column-name keywords of the PHI rule (V3).
PHI_NAME_KEYWORDS: list[str] = [
    "name", "address", "phone", "email", "ssn", "social", "security",
    "birth", "date", "zip", "postal", "medical", "record", "patient",
    "id", "identifier", "account", "license", "passport", "driver",
]

# FIXED VALUES: medical code formats of the code rule (V8), matched at the start.
CODE_PATTERNS: dict[str, str] = {
    "icd10": r"^[A-Z]\d{2}(\.\d{1,2})?$",
    "icd9": r"^\d{3}(\.\d{1,2})?$",
    "loinc": r"^\d{1,5}-\d$",
    "cpt": r"^\d{4}[A-Z]?$",
    "ndc": r"^\d{4}-\d{4}-\d{2}$",
}

# FIXED VALUES: pandas dtype name -> accepted expected-type names (V2).
TYPE_COMPATIBILITY: dict[str, list[str]] = {
    "int64": ["int", "integer", "int64"],
    "float64": ["float", "float64", "number"],
    "object": ["string", "str", "object", "text"],
    "datetime64[ns]": ["datetime", "date", "timestamp"],
    "bool": ["boolean", "bool"],
}

# --------------------------------------------------------------------------
# FIXED VALUES: compliance engine.
# --------------------------------------------------------------------------
HIPAA_NAMES = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"
HIPAA_SSN = r"\d{3}-\d{2}-\d{4}"
HIPAA_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
HIPAA_PHONE = r"\(\d{3}\)\s*\d{3}-\d{4}"
GDPR_SENSITIVE = r"\b(race|ethnicity|religion|health|biometric|genetic|sexuality)\b"

# (rule key, pattern, standard, rule_id, severity, message format, recommendation)
HIPAA_CHECKS = [
    ("names", HIPAA_NAMES, "HIPAA", "PHI_NAME_DETECTED", "high",
     "Potential names detected in column '%s'", "Consider de-identification"),
    ("ssn", HIPAA_SSN, "HIPAA", "PHI_SSN_DETECTED", "critical",
     "SSN pattern detected in column '%s'", "Immediate de-identification required"),
]
GDPR_CHECKS = [
    ("names", HIPAA_NAMES, "GDPR", "PERSONAL_DATA_DETECTED", "high",
     "Personal data detected in column '%s'", "Ensure lawful basis for processing"),
    ("ssn", HIPAA_SSN, "GDPR", "PERSONAL_DATA_DETECTED", "high",
     "Personal data detected in column '%s'", "Ensure lawful basis for processing"),
    ("email", HIPAA_EMAIL, "GDPR", "PERSONAL_DATA_DETECTED", "high",
     "Personal data detected in column '%s'", "Ensure lawful basis for processing"),
    ("phone", HIPAA_PHONE, "GDPR", "PERSONAL_DATA_DETECTED", "high",
     "Personal data detected in column '%s'", "Ensure lawful basis for processing"),
    ("sensitive", GDPR_SENSITIVE, "GDPR", "SENSITIVE_DATA_DETECTED", "critical",
     "Sensitive data detected in column '%s'", "Explicit consent required for processing"),
]

FDA_SIGNATURE_FIELDS = ["username", "user", "timestamp", "meaning"]
FDA_AUDIT_FIELDS = ["action", "change"]
# (standard, rule_id, severity, tokens, message prefix, recommendation)
FDA_CHECKS = [
    ("FDA", "MISSING_SIGNATURE_FIELDS", "high", FDA_SIGNATURE_FIELDS,
     "Missing electronic signature fields: ", "Implement electronic signature system"),
    ("FDA", "MISSING_AUDIT_FIELDS", "medium", FDA_AUDIT_FIELDS,
     "Missing audit trail fields: ", "Implement audit trail system"),
]

# Coding cell checks (C7-C9): standard -> (pattern, column-name keywords).
CODING_CHECKS: dict[str, tuple[str, list[str]]] = {
    "icd10": (r"^[A-Z]\d{2}(?:\.\d{1,2})?$", ["icd", "diagnosis"]),
    "loinc": (r"^\d{1,5}-\d$", ["loinc", "lab", "test"]),
    "cpt": (r"^\d{5}$", ["cpt", "procedure", "service"]),
}

# Score penalty per violation.
SCORE_PENALTY = {"hipaa": 10, "gdpr": 10, "fda": 20, "icd10": 10, "loinc": 10, "cpt": 10}

# Standard recommendations, two per violated standard.
STANDARD_RECOMMENDATIONS = {
    "hipaa": ["Implement data access controls", "Provide compliance training"],
    "gdpr": ["Review lawful basis for processing personal data",
             "Implement data minimization and retention policies"],
    "fda": ["Implement electronic signature and audit trail systems",
            "Document system validation procedures"],
}

DEFAULT_CUSTOM_RECOMMENDATION = "Review custom compliance rule"

# Risk level thresholds (C11): score >= t -> level, else "critical".
RISK_LEVELS = [(90, "low"), (70, "medium"), (50, "high")]

# --------------------------------------------------------------------------
# FIXED VALUES: compliance templates (C16a-e), rows of the rule catalog.
# (template, template description, rule name, description, pattern,
#  severity, field_pattern, recommendation)
# --------------------------------------------------------------------------
TEMPLATE_RULES = [
    ("clinical_trials", "Compliance template for clinical trial data",
     "subject_id_format", "Subject ID must follow clinical trial format",
     r"^[A-Z]{2}\d{6}$", "high", r"subject|participant|patient",
     "Use standard subject ID format: 2 letters + 6 digits"),
    ("clinical_trials", "Compliance template for clinical trial data",
     "visit_date_format", "Visit dates must be in ISO format",
     r"^\d{4}-\d{2}-\d{2}$", "medium", r"visit|date|time",
     "Use ISO date format: YYYY-MM-DD"),
    ("clinical_trials", "Compliance template for clinical trial data",
     "adverse_event_coding", "Adverse events must use MedDRA coding",
     r"^\d{8}$", "high", r"adverse|event|ae",
     "Use MedDRA preferred terms (8-digit codes)"),
    ("ehr", "Compliance template for Electronic Health Records",
     "patient_id_format", "Patient ID must follow EHR format",
     r"^P\d{8}$", "critical", r"patient|id|mrn",
     "Use standard patient ID format: P + 8 digits"),
    ("ehr", "Compliance template for Electronic Health Records",
     "vital_signs_range", "Vital signs must be within normal ranges",
     r"^(0|[1-9]\d{0,2})$", "medium", r"bp|heart_rate|temperature|weight",
     "Verify vital signs are within expected ranges"),
    ("ehr", "Compliance template for Electronic Health Records",
     "medication_dosage", "Medication dosages must include units",
     r"^\d+(\.\d+)?\s*(mg|mcg|g|ml|units?)$", "high", r"dosage|dose|amount",
     "Include units with all medication dosages"),
    ("laboratory", "Compliance template for laboratory data",
     "lab_result_format", "Lab results must include reference ranges",
     r"^\d+(\.\d+)?\s*[<>]?\s*\([0-9.-]+\s*-\s*[0-9.-]+\s*[a-zA-Z%]+\)$", "high",
     r"result|value|level",
     "Include reference ranges with lab results"),
    ("laboratory", "Compliance template for laboratory data",
     "specimen_id_format", "Specimen IDs must follow lab format",
     r"^SP\d{6}-\d{3}$", "medium", r"specimen|sample|collection",
     "Use standard specimen ID format: SP + 6 digits + dash + 3 digits"),
    ("laboratory", "Compliance template for laboratory data",
     "test_status", "Test status must be valid",
     r"^(completed|pending|cancelled|failed)$", "medium", r"status|state",
     "Use valid test status values"),
    ("imaging", "Compliance template for medical imaging data",
     "dicom_uid_format", "DICOM UIDs must follow standard format",
     r"^\d+\.\d+\.\d+\.\d+\.\d+\.\d+$", "high", r"dicom|uid|study|series|instance",
     "Use standard DICOM UID format"),
    ("imaging", "Compliance template for medical imaging data",
     "modality_codes", "Imaging modality must use standard codes",
     r"^(CT|MR|US|XR|NM|PT|CR|DX|MG|XA|RF|XA)$", "medium", r"modality|type",
     "Use standard DICOM modality codes"),
    ("imaging", "Compliance template for medical imaging data",
     "image_quality_score", "Image quality scores must be numeric",
     r"^[1-5]$", "medium", r"quality|score|rating",
     "Use 1-5 scale for image quality assessment"),
    ("research", "Compliance template for research data",
     "deidentified_id", "Research IDs must be de-identified",
     r"^R\d{6}$", "critical", r"id|identifier|subject",
     "Use de-identified research IDs only"),
    ("research", "Compliance template for research data",
     "consent_status", "Consent status must be documented",
     r"^(consented|declined|withdrawn|pending)$", "critical", r"consent|permission",
     "Document consent status for all participants"),
    ("research", "Compliance template for research data",
     "data_anonymization", "Check for potential re-identification risks",
     r"\b(19|20)\d{2}\b", "high", r"date|birth|age",
     "Ensure dates don't reveal birth years"),
]

# --------------------------------------------------------------------------
# FIXED VALUES: security module.
# --------------------------------------------------------------------------
HIPAA_PHI_PATTERNS: dict[str, str] = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b",
    "address": r"\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b",
    "medical_record": r"\bMRN\s*\d+\b|\bMedical\s*Record\s*\d+\b",
    "account_number": r"\bAccount\s*#?\s*\d+\b|\bAcct\s*#?\s*\d+\b",
    "insurance_id": r"\bInsurance\s*ID\s*\d+\b|\bPolicy\s*#\s*\d+\b",
    "license_number": r"\bLicense\s*#\s*\d+\b|\bLic\s*#\s*\d+\b",
    "vehicle_id": r"\bVIN\s*\d+\b|\bVehicle\s*ID\s*\d+\b",
    "device_id": r"\bDevice\s*ID\s*\d+\b|\bSerial\s*#\s*\d+\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "url": r"\bhttps?://[^\s]+\b",
    "biometric": r"\bFingerprint|Retina|Iris|Voice\s*Pattern\b",
}

# PHI recommendations (H3): first line when any PHI, then one per detected type.
PHI_FOUND_RECOMMENDATION = "⚠️ PHI detected in dataset. Consider anonymization or de-identification."
PHI_TYPE_RECOMMENDATIONS = [
    ("ssn", "🔒 Remove or hash Social Security Numbers"),
    ("email", "📧 Replace email addresses with generic identifiers"),
    ("phone", "📞 Mask phone numbers or use generic placeholders"),
    ("date", "📅 Consider date generalization (e.g., year only)"),
    ("address", "🏠 Remove or generalize addresses"),
]
NO_PHI_RECOMMENDATION = "✅ No PHI detected - dataset appears HIPAA compliant"

# Safe-harbor column categories (A1), tested in this order on the lower-cased name.
SAFE_HARBOR_CATEGORIES = [
    ("names", ["name", "first", "last"]),
    ("dates", ["date", "birth", "admission", "discharge"]),
    ("addresses", ["address", "street", "city", "state", "zip"]),
    ("identifiers", ["ssn", "id", "number", "account"]),
    ("contact", ["phone", "email", "fax"]),
]
REDACTED = "[REDACTED]"

# Date formats tried by the year generaliser (A4), in order (Java pattern letters).

# Plain-text audit (U1): patterns, penalty, pass mark and fixed advice.
AUDIT_PATTERNS = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
]
AUDIT_PENALTY = 15
AUDIT_SECURE_SCORE = 80
AUDIT_FIXED_RECOMMENDATIONS = [
    "Implement comprehensive access logging",
    "Monitor data access patterns for anomalies",
    "Set up alerts for unauthorized access attempts",
    "Maintain detailed audit trail of all data access",
    "Log all validation operations and results",
    "Implement data lineage tracking",
]

# Sanitiser (D1): patterns deleted case-insensitively, in this order.
SANITIZE_PATTERNS = [
    r"<script.*?</script>", r"javascript:", r"<iframe.*?</iframe>",
    r"<object.*?</object>", r"<embed.*?</embed>", r"<form.*?</form>",
    r"<input.*?>", r"<textarea.*?</textarea>", r"<select.*?</select>",
    r"<button.*?</button>", r"<link.*?>", r"<meta.*?>", r"<style.*?</style>",
    r"<title.*?</title>", r"<base.*?>", r"<bgsound.*?>",
    r"<link.*?>", r"<meta.*?>", r"<style.*?</style>", r"<title.*?</title>",
    r"<base.*?>", r"<bgsound.*?>",
]
SANITIZE_TAG = r"<[^>]+>"
SANITIZE_LITERALS = [";", "--", "/*", "*/"]
# Filename characters replaced by "_" (D2), in order.
FILENAME_BAD_CHARS = ["<", ">", ":", '"', "|", "?", "*", "\\", "/"]

# Text report layout (K3): title, rule widths, status words.
REPORT_TITLE = "Medical Data Validation Report"
REPORT_RULE = "=" * 40
REPORT_ISSUES_RULE = "-" * 20
REPORT_VALID = "✅ VALID"
REPORT_INVALID = "❌ INVALID"

# Upload admission.
ALLOWED_EXTENSIONS = ["csv", "xlsx", "xls", "json", "parquet"]
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
SAFE_FILENAME = r"^[a-zA-Z0-9._-]+$"

# --------------------------------------------------------------------------
# FIXED VALUES: analytics (Q5) and monitoring (M2) thresholds.
# --------------------------------------------------------------------------
QUALITY_THRESHOLDS = {
    "completeness": [(0.95, "excellent"), (0.85, "good"), (0.70, "fair"), (0.50, "poor")],
    "consistency": [(0.90, "excellent"), (0.80, "good"), (0.65, "fair"), (0.45, "poor")],
    "accuracy": [(0.95, "excellent"), (0.85, "good"), (0.70, "fair"), (0.50, "poor")],
    "timeliness": [(0.90, "excellent"), (0.80, "good"), (0.65, "fair"), (0.45, "poor")],
}
QUALITY_WEIGHTS = {"completeness": 0.3, "consistency": 0.25, "accuracy": 0.25, "timeliness": 0.2}
QUALITY_METRIC_INFO = {
    "completeness": ("Data Completeness", "Percentage of non-missing values across the dataset"),
    "consistency": ("Data Consistency", "Consistency of data types and formats across columns"),
    "accuracy": ("Data Accuracy", "Accuracy of data values based on statistical analysis"),
    "timeliness": ("Data Timeliness", "Recency of the data based on date fields"),
}

# metric -> (warning, critical); unknown metrics use DEFAULT_METRIC_THRESHOLDS.
MONITOR_THRESHOLDS = {
    "completeness": (0.85, 0.70),
    "consistency": (0.80, 0.65),
    "accuracy": (0.85, 0.70),
    "compliance_score": (0.80, 0.65),
}
DEFAULT_METRIC_THRESHOLDS = (0.8, 0.6)
DEGRADATION_DROP = -0.1          # alert when last - two-before < this
DEGRADATION_HIGH = -0.2          # "medium" when drop > this, else "high"
FAILURE_RATE_LIMIT = 0.3
ISSUE_VOLUME_LIMIT = 10
INACTIVITY_SECONDS = 3600
ALERT_RETENTION_DAYS = 7
HISTORY_LENGTH = 100

# --------------------------------------------------------------------------
# FIXED VALUES: validation profiles (V15a-g) as rule-catalog rows.
# kind: required | type | phi | quality | code | range | date
# (profile, kind, column, arg1, arg2)
#   type  -> arg1 expected type;  code -> arg1 code type
#   range -> arg1 min, arg2 max;  date -> arg1 min date, arg2 max date
# --------------------------------------------------------------------------
PROFILE_RULES = [
    ("clinical_trials", "required", "subject_id", None, None),
    ("clinical_trials", "required", "visit_date", None, None),
    ("clinical_trials", "required", "treatment_group", None, None),
    ("clinical_trials", "type", "subject_id", "string", None),
    ("clinical_trials", "type", "visit_date", "datetime", None),
    ("clinical_trials", "phi", None, None, None),
    ("clinical_trials", "quality", None, None, None),
    ("clinical_trials", "date", "visit_date", "2000-01-01", None),
    ("clinical_trials", "date", "screening_date", "2000-01-01", None),
    ("clinical_trials", "range", "age", 18, 100),
    ("clinical_trials", "range", "bmi", 15, 60),

    ("ehr", "required", "patient_id", None, None),
    ("ehr", "required", "encounter_date", None, None),
    ("ehr", "type", "patient_id", "string", None),
    ("ehr", "type", "encounter_date", "datetime", None),
    ("ehr", "phi", None, None, None),
    ("ehr", "quality", None, None, None),
    ("ehr", "code", "diagnosis_code", "icd10", None),
    ("ehr", "code", "procedure_code", "cpt", None),
    ("ehr", "code", "medication_code", "ndc", None),
    ("ehr", "date", "encounter_date", "1900-01-01", None),
    ("ehr", "date", "birth_date", "1900-01-01", None),

    ("imaging", "required", "image_id", None, None),
    ("imaging", "required", "patient_id", None, None),
    ("imaging", "required", "study_date", None, None),
    ("imaging", "type", "image_id", "string", None),
    ("imaging", "type", "patient_id", "string", None),
    ("imaging", "phi", None, None, None),
    ("imaging", "quality", None, None, None),
    ("imaging", "date", "study_date", "1990-01-01", None),
    ("imaging", "date", "acquisition_date", "1990-01-01", None),
    ("imaging", "range", "pixel_spacing", 0.1, 10.0),
    ("imaging", "range", "slice_thickness", 0.1, 50.0),

    ("lab", "required", "patient_id", None, None),
    ("lab", "required", "test_date", None, None),
    ("lab", "required", "test_code", None, None),
    ("lab", "type", "patient_id", "string", None),
    ("lab", "type", "test_date", "datetime", None),
    ("lab", "phi", None, None, None),
    ("lab", "quality", None, None, None),
    ("lab", "code", "test_code", "loinc", None),
    ("lab", "code", "diagnosis_code", "icd10", None),
    ("lab", "range", "test_value", -1000, 10000),
    ("lab", "date", "test_date", "2000-01-01", None),
    ("lab", "date", "collection_date", "2000-01-01", None),

    ("covid19", "required", "date", None, None),
    ("covid19", "required", "location", None, None),
    ("covid19", "required", "total_cases", None, None),
    ("covid19", "type", "date", "datetime", None),
    ("covid19", "type", "total_cases", "int", None),
    ("covid19", "type", "new_cases", "int", None),
    ("covid19", "type", "total_deaths", "int", None),
    ("covid19", "type", "population", "float", None),
    ("covid19", "range", "total_cases", 0, None),
    ("covid19", "range", "new_cases", 0, None),
    ("covid19", "range", "total_deaths", 0, None),
    ("covid19", "range", "population", 0, None),
    ("covid19", "range", "life_expectancy", 0, 120),
    ("covid19", "date", "date", "2019-12-01", "2024-12-31"),

    ("ehr_real", "required", "patient_id", None, None),
    ("ehr_real", "required", "admission_date", None, None),
    ("ehr_real", "required", "age", None, None),
    ("ehr_real", "type", "patient_id", "string", None),
    ("ehr_real", "type", "admission_date", "datetime", None),
    ("ehr_real", "type", "age", "int", None),
    ("ehr_real", "type", "temperature", "float", None),
    ("ehr_real", "type", "heart_rate", "int", None),
    ("ehr_real", "type", "total_charges", "float", None),
    ("ehr_real", "range", "age", 0, 120),
    ("ehr_real", "range", "temperature", 70, 110),
    ("ehr_real", "range", "heart_rate", 30, 250),
    ("ehr_real", "range", "blood_pressure_systolic", 50, 300),
    ("ehr_real", "range", "blood_pressure_diastolic", 30, 200),
    ("ehr_real", "range", "respiratory_rate", 5, 50),
    ("ehr_real", "range", "oxygen_saturation", 70, 100),
    ("ehr_real", "range", "glucose", 20, 1000),
    ("ehr_real", "range", "creatinine", 0.1, 50),
    ("ehr_real", "range", "hemoglobin", 5, 25),
    ("ehr_real", "range", "white_blood_cells", 0.1, 100),
    ("ehr_real", "range", "platelets", 10, 1000),
    ("ehr_real", "code", "primary_diagnosis", "icd10", None),
    ("ehr_real", "code", "secondary_diagnosis", "icd10", None),
    ("ehr_real", "date", "admission_date", "2010-01-01", "2024-12-31"),
    ("ehr_real", "date", "discharge_date", "2010-01-01", "2024-12-31"),

    ("heart_disease", "required", "age", None, None),
    ("heart_disease", "required", "sex", None, None),
    ("heart_disease", "required", "cp", None, None),
    ("heart_disease", "required", "target", None, None),
    ("heart_disease", "type", "age", "int", None),
    ("heart_disease", "type", "sex", "int", None),
    ("heart_disease", "type", "cp", "int", None),
    ("heart_disease", "type", "trestbps", "int", None),
    ("heart_disease", "type", "chol", "int", None),
    ("heart_disease", "type", "fbs", "int", None),
    ("heart_disease", "type", "restecg", "int", None),
    ("heart_disease", "type", "thalach", "int", None),
    ("heart_disease", "type", "exang", "int", None),
    ("heart_disease", "type", "oldpeak", "float", None),
    ("heart_disease", "type", "slope", "int", None),
    ("heart_disease", "type", "ca", "int", None),
    ("heart_disease", "type", "thal", "int", None),
    ("heart_disease", "type", "target", "int", None),
    ("heart_disease", "range", "age", 0, 120),
    ("heart_disease", "range", "trestbps", 50, 300),
    ("heart_disease", "range", "chol", 100, 600),
    ("heart_disease", "range", "thalach", 50, 250),
    ("heart_disease", "range", "oldpeak", 0, 10),
]

# Names the registry answers for.
REGISTRY_PROFILES = ["clinical_trials", "ehr", "imaging", "lab"]
