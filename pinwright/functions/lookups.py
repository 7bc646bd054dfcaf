"""Ranked lookup tables of the component-catalogue rules.

Every table here is a fixed value set: the results of the catalogue depend on
the exact words and, wherever a rule says "first match wins", on their order.
Order is kept as list position and travels through plans as a ``rank`` column
or an array literal, never as row arrival order.
"""

from __future__ import annotations

# --- Fixed values: package/reel suffixes of part numbers, in test order ------
SUFFIXES = [
    "DDCR", "DDC", "DDWR", "DDW", "DRCR", "DRC", "DGKR", "DGK", "RGER", "RGE", "RGTR", "RGT",
    "RGYR", "RGY", "PWPR", "PWP", "PWR", "PW", "DSGR", "DSG", "DCKR", "DCK", "DBVR", "DBV", "QDRR",
    "QDR", "RSAR", "RSA", "DGSR", "DGS", "RTER", "RTE", "YZFR", "YZF", "YFFR", "YFF", "RHAR",
    "RHA", "RHBR", "RHB", "DADR", "DAD", "DGNR", "DGN", "DLHR", "DLH", "DSCR", "DSC", "DWKR",
    "DWK", "DGQR", "DGQ", "DRBR", "DRB", "DRLR", "DRL", "DRVR", "DRV", "DDAR", "DDA", "IDGSR",
    "IDGS", "IDR", "ID", "MFXR", "MFX", "PDRLR", "PDRL", "DR", "D",
]

# --- Fixed values: package name or code to library footprint -----------------
PACKAGE_FOOTPRINTS = {
    "DDC": "Package_TO_SOT_SMD:SOT-23-6",
    "DCK": "Package_TO_SOT_SMD:SOT-353_SC-70-5",
    "DBV": "Package_TO_SOT_SMD:SOT-23-5",
    "DGK": "Package_DFN_QFN:TSSOP-8_4.4x3mm_P0.65mm",
    "DRC": "Package_SON:Texas_DRC0010J",
    "DRV": "Package_SON:WSON-6-1EP_2x2mm_P0.65mm_EP1x1.6mm",
    "DGN": "Package_SO:HVSSOP-8-1EP_3x3mm_P0.65mm_EP1.57x1.89mm",
    "DSG": "Package_TO_SOT_SMD:SOT-23-5",
    "PW": "Package_SO:TSSOP-16_4.4x5mm_P0.65mm",
    "PWP": "Package_SO:HTSSOP-16-1EP_4.4x5mm_P0.65mm_EP3.4x5mm",
    "DDW": "Package_SO:HTSSOP-44-1EP_6.1x14mm_P0.635mm_EP5.2x14mm_Mask4.31x8.26mm",
    "DAD": "Package_SO:HTSSOP-32-1EP_6.1x11mm_P0.65mm_EP5.2x11mm_Mask4.11x4.36mm",
    "RGE": "Package_DFN_QFN:QFN-24-1EP_4x4mm_P0.5mm_EP2.6x2.6mm",
    "RGT": "Package_DFN_QFN:QFN-16-1EP_3x3mm_P0.5mm_EP1.68x1.68mm",
    "RTE": "Package_DFN_QFN:Texas_RTE0016D_WQFN-16-1EP_3x3mm_P0.5mm_EP0.8x0.8mm",
    "RSA": "Package_DFN_QFN:QFN-40-1EP_5x5mm_P0.4mm_EP3.1x3.1mm",
    "QDR": "Package_SON:WSON-8-1EP_2x2mm_P0.5mm_EP0.9x1.6mm",
    "DRB": "Package_SON:Texas_DRB0008A_VSON-8-1EP_3x3mm_P0.65mm",
    "DRL": "Package_TO_SOT_SMD:SOT-5X3",
    "D": "Package_SO:SOIC-8_3.9x4.9mm_P1.27mm",
    "YZF": "Package_BGA:BGA-9_1.587x1.587mm_P0.5mm",
    "YFF": "Package_BGA:BGA-4_0.8x0.8mm_P0.4mm",
    "SOT-23-3": "Package_TO_SOT_SMD:SOT-23",
    "SOT-23-5": "Package_TO_SOT_SMD:SOT-23-5",
    "SOT-23-6": "Package_TO_SOT_SMD:SOT-23-6",
    "SOT-23-8": "Package_TO_SOT_SMD:SOT-23-8",
    "ID": "Package_SO:SOIC-8_3.9x4.9mm_P1.27mm",
    "IDGS": "Package_SO:VSSOP-10_3x3mm_P0.5mm",
    "DDA": "Package_SO:SOIC-8-1EP_3.9x4.9mm_P1.27mm_EP2.29x3mm",
    "MFX": "Package_TO_SOT_SMD:SOT-23-5",
    "SOIC-8": "Package_SO:SOIC-8_3.9x4.9mm_P1.27mm",
    "SOIC-14": "Package_SO:SOIC-14_3.9x8.7mm_P1.27mm",
    "SOIC-16": "Package_SO:SOIC-16_3.9x9.9mm_P1.27mm",
    "TSSOP-8": "Package_SO:TSSOP-8_4.4x3mm_P0.65mm",
    "TSSOP-14": "Package_SO:TSSOP-14_4.4x5mm_P0.65mm",
    "TSSOP-16": "Package_SO:TSSOP-16_4.4x5mm_P0.65mm",
    "TSSOP-20": "Package_SO:TSSOP-20_4.4x6.5mm_P0.65mm",
    "QFN-16": "Package_DFN_QFN:QFN-16-1EP_3x3mm_P0.5mm_EP1.68x1.68mm",
    "QFN-20": "Package_DFN_QFN:QFN-20-1EP_4x4mm_P0.5mm_EP2.6x2.6mm",
    "QFN-24": "Package_DFN_QFN:QFN-24-1EP_4x4mm_P0.5mm_EP2.6x2.6mm",
    "QFN-32": "Package_DFN_QFN:QFN-32-1EP_5x5mm_P0.5mm_EP3.1x3.1mm",
    "RGY": "Package_DFN_QFN:Texas_RGY_R-PVQFN-N24_EP2.05x3.1mm",
    "RHA": "Package_DFN_QFN:QFN-40-1EP_5x5mm_P0.4mm_EP3.1x3.1mm",
    "VQFN-24": "Package_DFN_QFN:Texas_RGY_R-PVQFN-N24_EP2.05x3.1mm",
    "VQFN-32": "Package_DFN_QFN:VQFN-32-1EP_5x5mm_P0.5mm_EP3.5x3.5mm",
    "VQFN-40": "Package_DFN_QFN:QFN-40-1EP_5x5mm_P0.4mm_EP3.1x3.1mm",
    "HTSSOP-16": "Package_SO:HTSSOP-16-1EP_4.4x5mm_P0.65mm_EP3.4x5mm",
    "HTSSOP-20": "Package_SO:HTSSOP-20-1EP_4.4x6.5mm_P0.65mm_EP3.4x6.5mm",
    "HTSSOP-24": "Package_SO:HTSSOP-24-1EP_4.4x7.8mm_P0.65mm_EP3.2x5mm",
    "HTSSOP-28": "Package_SO:HTSSOP-28-1EP_4.4x9.7mm_P0.65mm_EP3.4x9.5mm",
    "HTSSOP-32": "Package_SO:HTSSOP-32-1EP_6.1x11mm_P0.65mm_EP5.2x11mm_Mask4.11x4.36mm",
    "HTSSOP-38": "Package_SO:HTSSOP-38-1EP_6.1x12.5mm_P0.65mm_EP5.2x12.5mm_Mask3.39x6.35mm",
    "HTSSOP-44": "Package_SO:HTSSOP-44-1EP_6.1x14mm_P0.635mm_EP5.2x14mm_Mask4.31x8.26mm",
    "HVSSOP-8": "Package_SO:HVSSOP-8-1EP_3x3mm_P0.65mm_EP1.57x1.89mm",
    "HVSSOP-10": "Package_SO:HVSSOP-10-1EP_3x3mm_P0.5mm_EP1.57x1.88mm",
    "HVSSOP-20": "Package_SO:HTSSOP-20-1EP_4.4x6.5mm_P0.65mm_EP3.4x6.5mm",
    "HVSSOP-24": "Package_SO:HTSSOP-24-1EP_4.4x7.8mm_P0.65mm_EP3.2x5mm",
    "HVSSOP-28": "Package_SO:HTSSOP-28-1EP_4.4x9.7mm_P0.65mm_EP3.4x9.5mm",
    "DGQ": "Package_SO:HTSSOP-24-1EP_4.4x7.8mm_P0.65mm_EP3.2x5mm",
    "VSSOP-8": "Package_SO:TSSOP-8_3x3mm_P0.65mm",
    "VSSOP-10": "Package_SO:MSOP-10_3x3mm_P0.5mm",
    "VSSOP-14": "Package_SO:TSSOP-14_4.4x5mm_P0.65mm",
    "SSOP-16": "Package_SO:SSOP-16_5.3x6.2mm_P0.65mm",
    "SSOP-20": "Package_SO:SSOP-20_5.3x7.2mm_P0.65mm",
    "SSOP-24": "Package_SO:SSOP-24_5.3x8.2mm_P0.65mm",
    "SSOP-28": "Package_SO:SSOP-28_5.3x10.2mm_P0.65mm",
    "MSOP-8": "Package_SO:MSOP-8_3x3mm_P0.65mm",
    "MSOP-10": "Package_SO:MSOP-10_3x3mm_P0.5mm",
    "WQFN-16": "Package_DFN_QFN:Texas_RTE0016D_WQFN-16-1EP_3x3mm_P0.5mm_EP0.8x0.8mm",
    "WQFN-40": "Package_DFN_QFN:Texas_RNQ0040A_WQFN-40-1EP_6x4mm_P0.4mm_EP4.7x2.7mm",
    "QFN-40": "Package_DFN_QFN:QFN-40-1EP_5x5mm_P0.4mm_EP3.1x3.1mm",
    "WSON-8": "Package_SON:WSON-8-1EP_2x2mm_P0.5mm_EP0.9x1.6mm",
    "WSON-10": "Package_SON:WSON-10-1EP_2x3mm_P0.5mm_EP0.84x2.4mm",
    "PDIP-8": "Package_DIP:DIP-8_W7.62mm",
    "PDIP-14": "Package_DIP:DIP-14_W7.62mm",
    "PDIP-16": "Package_DIP:DIP-16_W7.62mm",
    "PDIP-20": "Package_DIP:DIP-20_W7.62mm",
    "PDIP-28": "Package_DIP:DIP-28_W7.62mm",
    "SOT-223": "Package_TO_SOT_SMD:SOT-223-3_TabPin2",
    "SOT-26": "Package_TO_SOT_SMD:SOT-23-6",
    "SOT-25": "Package_TO_SOT_SMD:SOT-23-5",
    "SOT-457": "Package_TO_SOT_SMD:SOT-23-6",
    "SOT-89-3": "Package_TO_SOT_SMD:SOT-89-3",
    "SOT-89-5": "Package_TO_SOT_SMD:SOT-89-5",
    "SOT-143": "Package_TO_SOT_SMD:SOT-143",
    "SOT-323": "Package_TO_SOT_SMD:SOT-323_SC-70",
    "SOT-343": "Package_TO_SOT_SMD:SOT-343_SC-70-4",
    "SOT-353": "Package_TO_SOT_SMD:SOT-353_SC-70-5",
    "SOT-363": "Package_TO_SOT_SMD:SOT-363_SC-70-6",
    "SOT-416": "Package_TO_SOT_SMD:SOT-416",
    "SOT-523": "Package_TO_SOT_SMD:SOT-523",
    "SOT-543": "Package_TO_SOT_SMD:SOT-543",
    "SOT-553": "Package_TO_SOT_SMD:SOT-553",
    "SOT-563": "Package_TO_SOT_SMD:SOT-563",
    "SOT-665": "Package_TO_SOT_SMD:SOT-665",
    "SOT-666": "Package_TO_SOT_SMD:SOT-666",
    "SOT-723": "Package_TO_SOT_SMD:SOT-723",
    "SOT-883": "Package_TO_SOT_SMD:SOT-883",
    "SOT-886": "Package_TO_SOT_SMD:SOT-886",
    "SOT-963": "Package_TO_SOT_SMD:SOT-963",
    "TSOP-5": "Package_SO:TSOP-5_1.65x3.05mm_P0.95mm",
    "TSOP-6": "Package_SO:TSOP-6_1.65x3.05mm_P0.95mm",
    "LQFP-32": "Package_QFP:LQFP-32_7x7mm_P0.8mm",
    "LQFP-44": "Package_QFP:LQFP-44_10x10mm_P0.8mm",
    "LQFP-48": "Package_QFP:LQFP-48_7x7mm_P0.5mm",
    "LQFP-64": "Package_QFP:LQFP-64_10x10mm_P0.5mm",
    "LQFP-100": "Package_QFP:LQFP-100_14x14mm_P0.5mm",
    "LQFP-144": "Package_QFP:LQFP-144_20x20mm_P0.5mm",
    "LQFP-176": "Package_QFP:LQFP-176_24x24mm_P0.5mm",
    "LQFP-208": "Package_QFP:LQFP-208_28x28mm_P0.5mm",
    "TQFP-32": "Package_QFP:TQFP-32_7x7mm_P0.8mm",
    "TQFP-44": "Package_QFP:TQFP-44_10x10mm_P0.8mm",
    "TQFP-48": "Package_QFP:TQFP-48_7x7mm_P0.5mm",
    "TQFP-64": "Package_QFP:TQFP-64_10x10mm_P0.5mm",
    "TQFP-100": "Package_QFP:TQFP-100_14x14mm_P0.5mm",
    "TQFP-144": "Package_QFP:TQFP-144_20x20mm_P0.5mm",
    "QFP-32": "Package_QFP:LQFP-32_7x7mm_P0.8mm",
    "QFP-44": "Package_QFP:TQFP-44_10x10mm_P0.8mm",
    "QFP-48": "Package_QFP:LQFP-48_7x7mm_P0.5mm",
    "QFP-64": "Package_QFP:LQFP-64_10x10mm_P0.5mm",
    "QFP-80": "Package_QFP:TQFP-80_12x12mm_P0.5mm",
    "QFP-100": "Package_QFP:LQFP-100_14x14mm_P0.5mm",
    "BGA-100": "Package_BGA:BGA-100_11.0x11.0mm_Layout10x10_P1.0mm_Ball0.5mm_Pad0.4mm_NSMD",
    "BGA-144": "Package_BGA:BGA-144_13.0x13.0mm_Layout12x12_P1.0mm",
    "BGA-256": "Package_BGA:BGA-256_17.0x17.0mm_Layout16x16_P1.0mm",
    "UFBGA-100": "Package_BGA:BGA-100_6.0x6.0mm_Layout11x11_P0.5mm_Ball0.3mm_Pad0.25mm_NSMD",
    "UFBGA-144": "Package_BGA:BGA-144_7.0x7.0mm_Layout13x13_P0.5mm_Ball0.3mm_Pad0.25mm_NSMD",
    "WLCSP-25": "Package_CSP:WLCSP-25_2.30x2.57mm_Layout5x5_P0.4mm",
    "WLCSP-36": "Package_CSP:WLCSP-36_2.57x3.07mm_Layout6x6_P0.4mm",
    "WLCSP-49": "Package_CSP:WLCSP-49_3.15x3.13mm_Layout7x7_P0.4mm",
    "TO-220-3": "Package_TO_SOT_THT:TO-220-3_Vertical",
    "TO-220-4": "Package_TO_SOT_THT:TO-220-4_Horizontal_TabDown",
    "TO-220-5": "Package_TO_SOT_THT:TO-220-5_Horizontal_TabDown",
    "TO-247-3": "Package_TO_SOT_THT:TO-247-3_Vertical",
    "TO-247-4": "Package_TO_SOT_THT:TO-247-4_Vertical",
    "TO-92": "Package_TO_SOT_THT:TO-92_Inline",
    "DIP-8": "Package_DIP:DIP-8_W7.62mm",
    "DIP-14": "Package_DIP:DIP-14_W7.62mm",
    "DIP-16": "Package_DIP:DIP-16_W7.62mm",
    "DIP-20": "Package_DIP:DIP-20_W7.62mm",
    "DIP-28": "Package_DIP:DIP-28_W7.62mm",
    "DIP-40": "Package_DIP:DIP-40_W15.24mm",
    "SOIC-20": "Package_SO:SOIC-20W_7.5x12.8mm_P1.27mm",
    "SOIC-24": "Package_SO:SOIC-24W_7.5x15.4mm_P1.27mm",
    "SOIC-28": "Package_SO:SOIC-28W_7.5x17.9mm_P1.27mm",
}

# --- Fixed values: package code -> (package name, pin count), in test order --
CODE_PACKAGES = {
    "DDC": ("SOT-23-6", 6), "DCK": ("SOT-353_SC-70-5", 5), "DBV": ("SOT-23-5", 5),
    "DGK": ("TSSOP-8", 8), "DGS": ("VSSOP-10", 10), "DGN": ("HVSSOP-8", 8),
    "DRV": ("WSON-6", 6), "DRC": ("SON-10", 10), "DSG": ("SOT-23-5", 5),
    "PWP": ("HTSSOP-16", 16), "RGE": ("QFN-24", 24), "RGT": ("QFN-16", 16),
    "RTE": ("WQFN-16", 16), "RSA": ("QFN-40", 40), "QDR": ("WSON-8", 8),
    "DLH": ("WSON-10", 10), "DSC": ("SOIC-8", 8), "DWK": ("SOIC-14", 14),
    "YZF": ("BGA-9", 9), "YFF": ("BGA-4", 4), "RGY": ("VQFN-24", 24),
    "RHA": ("VQFN-40", 40), "RHB": ("VQFN-32", 32), "DDW": ("HTSSOP-44", 44),
    "DAD": ("HTSSOP-32", 32), "DGQ": ("HVSSOP-24", 24), "DRB": ("SON-8", 8),
    "DRL": ("SOT-5X3", 6), "DDA": ("SOIC-8", 8), "ID": ("SOIC-8", 8),
    "IDGS": ("VSSOP-10", 10), "MFX": ("SOT-23-5", 5), "PDRL": ("SOT-563", 6),
    "D": ("SOIC-8", 8),
}

# --- Fixed values: pin counts of packages whose name carries no count --------
FIXED_PIN_COUNTS = {
    "SOT-23-3": 3, "SOT-23-5": 5, "SOT-23-6": 6, "SOT-23-8": 8, "SOT-89-3": 3,
    "SOT-89-5": 5, "SOT-143": 4, "SOT-223": 3, "SOT-323": 3, "SOT-343": 4,
    "SOT-353": 5, "SOT-363": 6, "SOT-416": 3, "SOT-523": 3, "SOT-543": 4,
    "SOT-553": 5, "SOT-563": 6, "SOT-665": 5, "SOT-666": 6, "SOT-723": 3,
    "SOT-883": 3, "SOT-886": 6, "SOT-963": 6, "TSOP-5": 5, "TSOP-6": 6,
    "TO-252": 3, "TO-263": 3, "TO-220-3": 3, "TO-247-3": 3, "TO-92": 3,
    "TO-3": 3, "IPAK": 3, "I2PAK": 3,
}

# --- Fixed values: package mentions in text, (pattern, name), in test order.
#     "{0}" is the captured pin count. All are matched without regard to case.
PACKAGE_PATTERNS = [
    (r"SOT-?26[A-Z]?\b", "SOT-23-6"),
    (r"SOT-?25\b", "SOT-23-5"),
    (r"SOT-?457\b", "SOT-23-6"),
    (r"SOT-?89[\s\-]+(\d)", "SOT-89-{0}"),
    (r"SOT-?89\b(?![\s\-]*\d)", "SOT-89-3"),
    (r"SOT-?143\b", "SOT-143"),
    (r"SOT-?323\b", "SOT-323"),
    (r"SOT-?343\b", "SOT-343"),
    (r"SOT-?353\b", "SOT-353"),
    (r"SOT-?363\b", "SOT-363"),
    (r"SOT-?416\b", "SOT-416"),
    (r"SOT-?523\b", "SOT-523"),
    (r"SOT-?543\b", "SOT-543"),
    (r"SOT-?553\b", "SOT-553"),
    (r"SOT-?563\b", "SOT-563"),
    (r"SOT-?583[\s\-]+(\d)", "SOT-583-{0}"),
    (r"SOT-?665\b", "SOT-665"),
    (r"SOT-?666\b", "SOT-666"),
    (r"SOT-?723\b", "SOT-723"),
    (r"SOT-?883\b", "SOT-883"),
    (r"SOT-?886\b", "SOT-886"),
    (r"SOT-?963\b", "SOT-963"),
    (r"TSOP-?5\b(?!\s*[\-_]?I)", "TSOP-5"),
    (r"TSOP-?6\b(?!\s*[\-_]?I)", "TSOP-6"),
    (r"SOT-?23[\s\-\(,]*(\d)\b(?!\.)", "SOT-23-{0}"),
    (r"(\d)-?[Pp]in\s+SOT-?23\b", "SOT-23-{0}"),
    (r"SOT-?23(?![\d\s\-\(,]*\d)", "SOT-23-3"),
    (r"SOIC[\s\-\(,|]+(\d+)\b(?!\.)\)?", "SOIC-{0}"),
    (r"(\d+)-?(?:[Pp](?:in|ad)|[Ll]ead)\s+SOIC", "SOIC-{0}"),
    (r"MSOP[\s\-\(,|]+(\d+)\b(?!\.)\)?", "MSOP-{0}"),
    (r"(?<!H)VSSOP[\s\-\(,|]+(\d+)\b(?!\.)\)?", "VSSOP-{0}"),
    (r"HTSSOP[\s\-\(,|]+(\d{2,})\)?", "HTSSOP-{0}"),
    (r"(\d{2,})-?[Pp]in\s+HTSSOP", "HTSSOP-{0}"),
    (r"HVSSOP[\s\-\(,|]+(\d+)\b(?!\.)\)?", "HVSSOP-{0}"),
    (r"(\d+)-?[Pp]in\s+HVSSOP", "HVSSOP-{0}"),
    (r"(?<!H)TSSOP[\s\-\(,|]+(\d{2,})\)?", "TSSOP-{0}"),
    (r"(\d{2,})-?(?:[Pp](?:in|ad)|[Ll]ead)\s+TSSOP", "TSSOP-{0}"),
    (r"(?<![HTVA-Z])SSOP[\s\-\(,|]+(\d{2,})\)?", "SSOP-{0}"),
    (r"WQFN[\s\-\(,|]+(\d{2,})\)?", "WQFN-{0}"),
    (r"VQFN[\s\-\(,|]?(\d{2,})\)?", "VQFN-{0}"),
    (r"(?<![WV])QFN[\s\-\(,|]+(\d{2,})\)?", "QFN-{0}"),
    (r"(\d{2,})-?(?:[Pp](?:in|ad)|[Ll]ead)\s+(?:W|V)?QFN", "QFN-{0}"),
    (r"WSON[\s\-\(,|]+(\d+)\b(?!\.)\)?", "WSON-{0}"),
    (r"DFN[\s\-\(,|]+(\d+)\b(?!\.)\)?", "DFN-{0}"),
    (r"LQFP[\s\-\(,|]+(\d{2,})\)?", "LQFP-{0}"),
    (r"(\d{2,})-?(?:[Pp](?:in|ad)|[Ll]ead)\s+LQFP", "LQFP-{0}"),
    (r"TQFP[\s\-\(,|]+(\d{2,})\)?", "TQFP-{0}"),
    (r"(\d{2,})-?(?:[Pp](?:in|ad)|[Ll]ead)\s+TQFP", "TQFP-{0}"),
    (r"(?<!DS)BGA[\s\-\(,|]+(\d{2,})\)?", "BGA-{0}"),
    (r"DSBGA[\s\-\(,|]+(\d+)\b(?!\.)\)?", "DSBGA-{0}"),
    (r"WCSP[\s\-\(,|]+(\d+)\b(?!\.)\)?", "WCSP-{0}"),
    (r"PDIP[\s\-\(,|]+(\d{2,})\)?", "PDIP-{0}"),
    (r"(\d{2,})-?[Pp]in\s+PDIP", "PDIP-{0}"),
    (r"SC-?70-?(\d)", "SC-70-{0}"),
    (r"SOT-?223", "SOT-223"),
    (r"SOT-?583", "SOT-583"),
    (r"TO-?252", "TO-252"),
    (r"TO-?263", "TO-263"),
    (r"D-?PAK", "TO-252"),
    (r"D2-?PAK", "TO-263"),
    (r"TO-?220[\s\-]+(\d+)", "TO-220-{0}"),
    (r"TO-?220\b(?![\s\-]*\d)", "TO-220-3"),
    (r"TO-?247[\s\-]+(\d+)", "TO-247-{0}"),
    (r"TO-?247\b(?![\s\-]*\d)", "TO-247-3"),
    (r"TO-?92\b", "TO-92"),
    (r"TO-?3P?\b", "TO-3"),
    (r"I-?PAK\b", "IPAK"),
    (r"I2-?PAK\b", "I2PAK"),
    (r"(?<![LT])QFP[\s\-\(,|]+(\d{2,})\)?", "QFP-{0}"),
    (r"(\d{2,})-?(?:[Pp](?:in|ad)|[Ll]ead)\s+QFP", "QFP-{0}"),
    (r"WLCSP[\s\-\(,|]+(\d+)\b(?!\.)\)?", "WLCSP-{0}"),
    (r"(\d+)-?(?:[Pp](?:in|ad)|[Bb]all)\s+WLCSP", "WLCSP-{0}"),
    (r"[UT]FBGA[\s\-\(,|]+(\d+)\b(?!\.)\)?", "UFBGA-{0}"),
    (r"(\d+)-?(?:[Pp](?:in|ad)|[Bb]all)\s+[UT]FBGA", "UFBGA-{0}"),
]

# --- Fixed values: "CODE (FAMILY, n)" in a package cell and in running text --
PACKAGE_CELL = r"([A-Z]{1,5})\s*\(\s*([A-Z][A-Z0-9\-]+)[\s,]+(\d+)\s*\)"
PACKAGE_INLINE = r"\b([A-Z]{2,5})\s*\(\s*([A-Z][A-Z0-9\-]+)[\s,]+(\d+)\s*\)"

# --- Fixed values: pin type by anchored name pattern, in test order ----------
PIN_TYPE_BY_NAME = [
    (r"^V(IN|CC|DD|BAT|BUS|SYS)$", "power_in"),
    (r"^[APD]?VDD$", "power_in"),
    (r"^DVDD$", "power_in"),
    (r"^AVDD$", "power_in"),
    (r"^PVDD$", "power_in"),
    (r"^VM$", "power_in"),
    (r"^VS$", "power_in"),
    (r"^VBB$", "power_in"),
    (r"^VDRAIN$", "power_in"),
    (r"^V(OUT|SW)$", "power_out"),
    (r"^VREG$", "power_out"),
    (r"^[APD]?GND$", "power_in"),
    (r"^EP$", "power_in"),
    (r"^PAD$", "power_in"),
    (r"^EPAD$", "power_in"),
    (r"^THERMAL\s*PAD$", "power_in"),
    (r"^N?EN$", "input"),
    (r"^ENABLE$", "input"),
    (r"^N?SLEEP$", "input"),
    (r"^N?RESET$", "input"),
    (r"^(N)?SS$", "passive"),
    (r"^SYNC$", "input"),
    (r"^CLK$", "input"),
    (r"^RT$", "passive"),
    (r"^COMP$", "passive"),
    (r"^FB$", "input"),
    (r"^BOOT$", "passive"),
    (r"^BST$", "passive"),
    (r"^IN\d*[HL]?$", "input"),
    (r"^INH[12]?$", "input"),
    (r"^INL[12]?$", "input"),
    (r"^LDO(EN|FB)$", "input"),
    (r"^MODE$", "input"),
    (r"^DRVOFF$", "input"),
    (r"^VREF$", "passive"),
    (r"^REF$", "passive"),
    (r"^ISET$", "passive"),
    (r"^ILIM$", "passive"),
    (r"^PMODE$", "input"),
    (r"^PG(OOD)?$", "open_collector"),
    (r"^N?FAULT$", "open_collector"),
    (r"^N?ALRT$", "open_collector"),
    (r"^N?ALERT$", "open_collector"),
    (r"^SW$", "power_out"),
    (r"^OUT[A-Z]?\d*$", "output"),
    (r"^LX$", "power_out"),
    (r"^PH$", "power_out"),
    (r"^LDOOUT$", "power_out"),
    (r"^VPROPI$", "output"),
    (r"^IPROPI$", "output"),
    (r"^IMON$", "output"),
    (r"^OUT[12][HL]?$", "output"),
    (r"^[AB]OUT\d?$", "output"),
    (r"^GH[A-Z]?\d*$", "output"),
    (r"^GL[A-Z]?\d*$", "output"),
    (r"^SH[A-Z]?\d*$", "output"),
    (r"^SL[A-Z]?\d*$", "output"),
    (r"^[AB]IN\d?$", "input"),
    (r"^[AB]ISEN$", "output"),
    (r"^VINT$", "power_out"),
    (r"^SDA$", "bidirectional"),
    (r"^SCL$", "input"),
    (r"^GPIO\d*$", "bidirectional"),
    (r"^SR$", "passive"),
    (r"^NC$", "no_connect"),
    (r"^N\.?C\.?$", "no_connect"),
    (r"^DNC$", "no_connect"),
    (r"^VCP$", "passive"),
    (r"^CPH$", "passive"),
    (r"^CPL$", "passive"),
]

# --- Fixed values: pin type by description phrase, in test order.
#     Each row: (any of these, all of these, none of these, type).
PIN_TYPE_BY_PHRASE = [
    (["power supply", "supply voltage"], [], [], "power_in"),
    (["device supply"], [], [], "power_in"),
    (["ground"], [], [], "power_in"),
    (["motor supply", "bridge supply"], [], [], "power_in"),
    ([], ["output"], ["input"], "output"),
    (["half-bridge output", "h-bridge output"], [], [], "output"),
    ([], ["input"], ["output"], "input"),
    (["enable"], [], [], "input"),
    (["feedback"], [], [], "input"),
    (["open drain", "open collector"], [], [], "open_collector"),
    ([], ["fault", "output"], [], "open_collector"),
    (["bidirectional"], [], [], "bidirectional"),
    (["no connect", "not connected"], [], [], "no_connect"),
    (["do not connect"], [], [], "no_connect"),
    (["regulator output"], [], [], "power_out"),
    (["charge pump"], [], [], "passive"),
    (["bootstrap"], [], [], "passive"),
    (["bypass", "decoupling"], [], [], "passive"),
    (["current sense", "current monitor"], [], [], "output"),
    (["reference"], [], [], "passive"),
    (["compensation", "soft start"], [], [], "passive"),
]

# --- Fixed values: I/O cell to pin type; unknown and dashes give no type -----
IO_TYPES = {
    "I": "input", "O": "output", "I/O": "bidirectional", "IO": "bidirectional",
    "P": "power_in", "PWR": "power_in", "POWER": "power_in", "S": "passive",
    "ANALOG": "passive", "A": "passive", "OD": "open_collector",
    "OC": "open_collector", "OPEN DRAIN": "open_collector",
    "OPEN COLLECTOR": "open_collector", "INPUT": "input", "OUTPUT": "output",
    "BIDIRECTIONAL": "bidirectional", "GND": "power_in", "SUPPLY": "power_in",
}

# --- Fixed values: types a model answer may use -------------------------------
ANSWER_TYPES = [
    "input", "output", "bidirectional", "power_in", "power_out", "passive",
    "open_collector", "open_emitter", "no_connect",
]

# --- Fixed values: full words shortened in pin names --------------------------
NAME_SHORT_FORMS = {
    "OUTPUT": "OUT", "GROUND": "GND", "FEEDBACK": "FB", "INPUT": "IN",
    "ENABLE": "EN",
}

# --- Fixed values: header cell roles. Anchored at the start, any case. --------
HEADER_PIN = [
    r"^pins?\s*(no\.?|number|#)?$",
    r"^(terminal\s*)?no\.?$",
    r"^terminal\s+no\.?$",
    r"^#$",
    r"^pin\s+(?!name|type|desc)[\w\-./(),\s']+$",
    r"^(PWP|RTE|DDW|DAD|RGE|RGT|RGY|RHA|RHB|DRC|DDC|DBV|DCK|DGK|DGS|DGQ|DSG|RSA|QDR"
    r"|SOT[\-\s]*\d*|SOIC|MSOP|TSSOP|SSOP|VSON|X2SON|WSON|DFN|QFN|BGA|DSBGA|SON"
    r"|TDFN|WLP|LFCSP|UCSP|WLCSP|BUMPS?)[\w\-]*(\s*\(\d+\))?$",
    r"^in\s+num(ber)?\.?$",
    r"^num(ber)?(s|\(s\))?\.?$",
    r"^pin\s*/\s*(bump|ball)$",
    r"^n\s+no\.?$",
]
HEADER_NAME = [
    r"^(pin\s*)?name$", r"^terminal(\s+name)?$", r"^terminal\s+name$",
    r"^signal(\s+name)?$", r"^function$", r"^pi?\s+name$", r"^mnemonic$",
    r"^symbol$",
]
HEADER_TYPE = [
    r"^i/?o(\(\d+\))?$", r"^(type|direction)(\(\d+\))?$", r"^pin\s*type$",
]
HEADER_DESC = [
    r"^desc(ription)?$", r"^function(al)?\s*desc", r"^function$",
    r"^pin\s+function$",
]
HEADER_ALT = [
    r"^alt(ernate)?\s*(function|func)s?", r"^additional\s+function",
    r"^AF\d+", r"^remap", r"^default\s*/\s*remap", r"^gpio\s+config",
]

# --- Fixed values: words a section-heading row may consist of -----------------
SECTION_WORDS = [
    "power", "ground", "control", "output", "input", "analog", "digital", "supply",
    "communication", "interface", "test", "misc", "other", "signal", "clock", "system", "thermal",
    "status",
]

# --- Fixed values: pad wording in a number cell, a name and a description -----
PAD_NUMBER_CELL = (
    r"(?i)^(thermal\s*pad|thermalpad|epad|e\.?p\.?|pad|exposed\s*pad|power\s*pad|powerpad)"
)
PAD_NAME = r"^(PAD|EP|EPAD|THERMAL\s*PAD|POWER\s*PAD|EXPOSED\s*PAD)$"
PAD_DESCRIPTION = r"power\s*pad|thermal\s*pad|exposed\s*pad"

# --- Fixed values: what an ordinary pin name looks like ------------------------
STANDARD_PIN_NAME = (
    r"^(V(CC|DD|IN|OUT|REF|BAT|BUS|SS|EE|REG|SYS|S\+?)|[AP]?GND|EP|NC|N/C|"
    r"EN|FB|SW|BOOT|BST|COMP|SS|PG|RT|CLK|IN\d?|OUT\d?|"
    r"SDA|SCL|MOSI|MISO|SCLK|CS|TXD?|RXD?|CTS|RTS|DTR|DSR|DCD|RI|"
    r"GPIO\d+|P[A-Z]\d+|IO[BT]_|[A-Z]{1,3}\d*[\+\-]?|\d+[A-Z]{2,}[\+\-]?|"
    "[\\+\\-–][A-Z]{2,}[A-D]?|" r"[A-Z][A-Z0-9_/\-\+]{0,12})$"
)

# --- Fixed values: maker by part-number prefix, in test order -----------------
MAKER_PREFIXES = [
    ("TI",
     r"^(TPS|TLV|LM[0-9R]|OPA|INA|ADS|BQ[0-9]|SN[0-9]|SN74|TCA|TXS|CD[0-9]|DRV|UCC|"
     r"MC[0-9]|LP[0-9]|LMR|TLC|REF[0-9]|DAC[0-9]|MSP|TMS|ISO[0-9]|AMC|TMP[0-9]|TMUX|"
     r"TCAN|CSD|TPA|THVD|TPL|PCM|LMH|LMG|THS|OPT|HDC|ADS1|ADS8|TXB|SN65|TAS|LMK|"
     r"TI[0-9]|TLIN|TIOL|BUF|IWR|AWR|LDC|DCP|TLK|DP[0-9]|XTR|DAC[0-9])"),
    ("Analog Devices",
     r"^(AD[0-9GPMS]|ADP|ADM|ADG|ADL|ADA|ADR|ADN|ADUM|LT[0-9C]|LTC|LTM|LTP|MAX[0-9]|"
     r"HMC|ADXL|ADIS|SSM|ADV)"),
    ("Microchip",
     r"^(MCP|PIC|dsPIC|ATSAMD|AT[0-9MTSX]|ATSAM|MIC[0-9]|SST|EQCO|PAC[0-9]|EMC[0-9]|"
     r"MTA|KSZ)"),
    ("ON Semiconductor",
     r"^(NCV|NCP|FAN[0-9]|NB[0-9]|NCS|NIS|NJM|NSR|NVMFS|FDP|NUD|FUSB|NLU|CAT|NTB|FPF|ACS)"),
    ("STMicroelectronics",
     r"^(STM|ST[A-Z][0-9]|L[0-9]{3}|TS[0-9]{3}|VL[0-9]|LSM|LIS|STPS|STW|STD|"
     r"STP[A-Z0-9]|VIPER|PM[0-9]|STSPIN|VN[HQ0-9]|L298)"),
    ("Allegro", r"^(A[0-9]{3,4}|ACS[0-9]|ALS[0-9]|ARG[0-9])"),
    ("InvenSense", r"^(MPU|ICM|ICS|IAM)"),
    ("NXP", r"^(TJA|TJF|TEA|S32|MK[A-Z0-9]|PCF|PCA|SAA)"),
]

# --- Fixed values: document address forms of the makers -----------------------
TI_RESOLVER = "https://www.ti.com/lit/gpn/"
TI_SYMLINK = "https://www.ti.com/lit/ds/symlink/"
ADI_SHEETS = "https://www.analog.com/media/en/technical-documentation/data-sheets/"
MICROCHIP_DOCS = "https://ww1.microchip.com/downloads/en/DeviceDoc/"
ONSEMI_SHEETS = "https://www.onsemi.com/download/data-sheet/pdf/"
ST_SHEETS = "https://www.st.com/resource/en/datasheet/"
NXP_SHEETS = "https://www.nxp.com/docs/en/data-sheet/"
LINEAR_REVISIONS = ["fb", "fc", "fd", "fe", "ff", "fh"]

# --- Fixed values: ordering-suffix patterns of three makers -------------------
MAXIM_ORDERING = r"^(MAX\d+\w*?)([GXEUW]\+(?:T\d*)?|\+T?\d*)$"
ADI_ORDERING = (
    r"^((?:AD|ADP|ADM|ADG|ADL|ADA|ADR|ADN|ADUM)\w*?)([A-Z]{2,4}Z(?:-\d+\.?\d*)?)$"
)
LINEAR_ORDERING = (
    r"^(LT[CM]?\d{3,5}\w?)(?:[CEI][A-Z]?\d?|M[PS]?(?:BF)?|(?:EGN|MPBF|EMSE|HMS)).*$"
)
VOLTAGE_ORDERING = r"^(.+?)-(\d+\.?\d*)$"
LINEAR_NUMBER = r"^LT[CM]?(\d{3,5}\w?)$"

# --- Fixed values: domain to maker, in test order -----------------------------
DOMAIN_MAKERS = [
    ("ti.com", "TI"), ("analog.com", "Analog Devices"),
    ("microchip.com", "Microchip"), ("onsemi.com", "ON Semiconductor"),
    ("st.com", "STMicroelectronics"), ("nxp.com", "NXP"),
    ("infineon.com", "Infineon"), ("renesas.com", "Renesas"),
    ("diodes.com", "Diodes Inc"), ("rohm.com", "ROHM"),
    ("allegromicro.com", "Allegro"), ("invensense.tdk.com", "InvenSense"),
    ("tdk.com", "TDK"), ("bosch-sensortec.com", "Bosch"),
    ("espressif.com", "Espressif"), ("wch-ic.com", "WCH"),
    ("ftdichip.com", "FTDI"), ("vishay.com", "Vishay"),
]

# --- Fixed values: address tiers ----------------------------------------------
REJECTED_SITES = [
    "handsontec.com", "instructables.com", "arduino.cc", "adafruit.com/product",
    "sparkfun.com/product", "youtube.com", "github.com", "hackaday.com",
]
MAKER_SITES = [
    "ti.com", "analog.com", "microchip.com", "onsemi.com", "st.com", "nxp.com", "infineon.com",
    "renesas.com", "diodes.com", "rohm.com", "allegromicro.com", "invensense.com", "tdk.com",
    "bosch-sensortec.com", "espressif.com", "raspberrypi.com", "wch-ic.com", "wch.cn",
    "ftdichip.com", "maxlinear.com", "vishay.com", "mouser.com", "digikey.com", "arrow.com",
]
AGGREGATOR_SITES = [
    "alldatasheet.com", "datasheet4u.com", "datasheets.com", "mouser.com", "digikey.com",
    "arrow.com", "lcsc.com",
]

# --- Fixed values: words that disqualify a description line -------------------
DESCRIPTION_SKIP = [
    "active", "production", "t&r", "reel", "tube", "tray", "qty", "package",
    "orderable", "addendum", "large", "3000", "2500", "1000", "tape",
    "tools & support", "order", "technical", "reference design", "copyright",
    "document", "revision",
]

# --- Fixed values: component class by keyword, in test order ------------------
COMPONENT_KEYWORDS = [
    ("motor_driver", ["h-bridge", "motor driver", "half-bridge", "brushed dc",
                      "stepper driver", "bldc driver"]),
    ("gate_driver", ["gate driver", "mosfet driver"]),
    ("led_driver", ["led driver", "led controller"]),
    ("mcu", ["microcontroller", "microprocessor"]),
    ("op_amp", ["operational amplifier", "op amp", "opamp"]),
    ("adc", ["analog-to-digital", "analog to digital", "a/d converter"]),
    ("dac", ["digital-to-analog", "digital to analog", "d/a converter"]),
    ("power_switch", ["load switch", "power switch", "high-side switch",
                      "low-side switch"]),
    ("voltage regulator", ["step-down", "buck converter", "switching regulator",
                           "step-up", "boost converter", "ldo", "linear regulator"]),
    ("sensor", ["sensor", "temperature", "accelerometer", "gyroscope"]),
    ("interface", ["uart", "spi", "i2c", "rs-232", "rs-485", "can bus"]),
    ("battery", ["battery charger", "battery management", "fuel gauge"]),
]

# --- Fixed values: generic library symbols by component class, in order -------
GENERIC_SYMBOLS = [
    ("voltage regulator", "Regulator_Switching", "TPS5430"),
    ("voltage regulator", "Regulator_Linear", "LM317_TO-252"),
    ("op_amp", "Amplifier_Operational", "LM358"),
    ("adc", "Analog_ADC", "MCP3008"),
    ("led_driver", "Driver_LED", "TLC5940"),
    ("mcu", "MCU_ST_STM32F1", "STM32F103C8Tx"),
    ("mcu", "MCU_Microchip_ATmega", "ATmega328P-AU"),
    ("microcontroller", "MCU_ST_STM32F1", "STM32F103C8Tx"),
    ("microcontroller", "MCU_Microchip_ATmega", "ATmega328P-AU"),
    ("fpga", "FPGA_Lattice", "ICE40UP5K-SG48"),
    ("cpld", "FPGA_Lattice", "ICE40UP5K-SG48"),
    ("memory", "Memory_Flash", "W25Q128JVS"),
    ("flash", "Memory_Flash", "W25Q128JVS"),
    ("eeprom", "Memory_EEPROM", "AT24C256C-SSHL-T"),
    ("sram", "Memory_RAM", "IS62WV12816DALL"),
    ("mosfet", "Transistor_FET", "IRF540N"),
    ("n_mosfet", "Transistor_FET", "IRF540N"),
    ("p_mosfet", "Transistor_FET", "IRF9540N"),
    ("diode", "Diode", "1N4148"),
    ("zener", "Diode", "BZX84Cxx"),
    ("bjt_npn", "Transistor_BJT", "BC547"),
    ("bjt_pnp", "Transistor_BJT", "BC557"),
    ("bjt", "Transistor_BJT", "BC547"),
    ("igbt", "Transistor_IGBT", "IRG4PC40U"),
    ("comparator", "Comparator", "LM393"),
    ("interface", "Interface_CAN_LIN", "MCP2551-I-SN"),
    ("sensor", "Sensor_Temperature", "LM75BIM"),
]

# --- Fixed values: thermal-pad labels and interchangeable pin names ------------
THERMAL_LABELS = ["EP", "TP", "EPAD", "THERMAL PAD", "THERMALPAD"]
NAME_ALIASES = [
    ("GNDPAD", "GND"), ("ETPAD", "GND"), ("EP", "GND"), ("PGND", "GND"),
    ("AGND", "GND"), ("PAD", "GND"), ("DAP", "GND"), ("GROUND", "GND"),
    ("THERMALPAD", "GND"), ("THERMALPAD", "GNDPAD"), ("DAP", "GNDPAD"),
    ("AGND", "GNDPAD"), ("PAD", "GNDPAD"), ("PH", "SW"), ("VSENSE", "FB"),
    ("ON/OFF", "EN"), ("VCC", "VIN"), ("IN", "VIN"), ("PVIN", "VIN"),
    ("AVIN", "VIN"), ("OUT", "VOUT"), ("OUTPUT", "OUT"), ("FEEDBACK", "FB"),
    ("ENA", "EN"), ("NFAULT", "FAULT"), ("PADGND", "GND"), ("EPAD", "GND"),
    ("EXPOSED PAD", "GND"), ("ALERT", "ALRT"), ("ALR", "ALRT"),
    ("SCLK", "SCL"), ("INT", "~{INT}"), ("SHDN", "~{SHDN}"),
    ("CHRG", "~{CHRG}"), ("FAULT", "~{FAULT}"), ("IN+", "VIN+"),
    ("IN-", "VIN-"), ("V", "VIN"), ("V", "VFB"), ("V", "VIN_REG"),
    ("QSPI_CSN", "QSPI_SS"), ("N/C", "NC"), ("N.C.", "NC"),
    ("VREG_VIN", "VREG_IN"), ("RT", "SS"),
]
OPAMP_OUTPUT = r"^(\d*)OUT([A-D]?\d*)$"
OPAMP_PLUS = r"^(\d*)IN(\d*)\+|^(\d*)\+IN([A-D]?\d*)$"
OPAMP_MINUS = r"^(\d*)IN(\d*)[\-]|^(\d*)[\-]IN([A-D]?\d*)$"
OPAMP_VPLUS = ["VCC", "VCC+", "V+", "VS+", "+VS", "+V"]
OPAMP_VMINUS = ["GND", "VCC-", "V-", "VEE", "VS-", "-VS", "VSS"]

# --- Fixed values: names that must never be typed no-connect ------------------
POWER_NAMES = ["VCC", "VDD", "V+", "V-", "VSS", "GND", "AVCC", "AVDD"]

# --- Fixed values: drawing layers kept, shape tags, ground names --------------
DRAWN_LAYERS = ["F.SilkS", "F.CrtYd", "F.Fab", "B.SilkS", "B.CrtYd", "B.Fab", "F.Cu", "B.Cu"]
SYMBOL_SHAPES = ["rectangle", "polyline", "arc", "circle", "text", "bezier"]
FOOTPRINT_SHAPES = ["fp_line", "fp_arc", "fp_circle", "fp_poly", "fp_text", "fp_rect"]
GROUND_NAMES = ["GND", "AGND", "PGND", "EP", "EPAD", "PAD"]

# --- Fixed values: limits ------------------------------------------------------
MIN_DOCUMENT_BYTES = 1_000
MAX_DOCUMENT_BYTES = 50 * 1024 * 1024
CONTEXT_BUDGET = 30_000
CONTEXT_MIN_REMAINDER = 500
FREE_QUOTA = 3
TOKEN_SECONDS = 300
JOB_SECONDS = 1_800
SNAPSHOT_DAYS = 7
LICENSED_STATUSES = ["active", "trialing", "past_due"]


# Heading, end and line patterns of pin sections.
SECTION_HEAD = r"(?imd)^Pin\s+No\.?\s+(?:Mnemonic|Name|Symbol)\s+(?:Description|Function)"
SECTION_HEAD_SPLIT = (
    r"(?imd)^Pin\s+No\.?\s*$\n^(?:[A-Z][\w-]*\s+)*(?:Mnemonic|Name|Symbol)\s+(?:Description|Function)"
)
SECTION_END = (
    r"(?imd)^(?:TYPICAL|ABSOLUTE|ELECTRICAL|THERMAL|ORDERING|PACKAGE|APPLICATION|BLOCK\s+DIAGRAM"
    r"|Figure\s+\d|Table\s+\d|Rev\.\s+[A-Z])"
)
PIN_NAME = r"([A-Z][A-Z0-9_/\-\+\.]*(?:\s*/\s*[A-Z][A-Z0-9_/\-\+\.]*)?)"
LINE_DUAL = r"(?md)^(\d+)\s+(\d+)\s+" + PIN_NAME + r"\s+(.*?)$"
LINE_SINGLE = r"(?md)^(\d+)\s*(?:\(EPAD\)\s*)?" + PIN_NAME + r"\s+(.*?)$"
LINE_EPAD = r"(?imd)^(?:\d+\s+)?(?:\d+\s+)?(?:\(EPAD\)\s*)?(?:EPAD|Exposed\s+Pad)\s+(.*?)$"
NAMED_PINS = (
    r"([A-Z][A-Z0-9_/]*)\s*\((?:Pins?\s+[\d]+(?:\s*,\s*\d+)*(?:\s*,\s*Exposed\s+Pad\s+Pin\s+\d+)?\s*/)?"
    r"Pins?\s+([\d]+(?:\s*,\s*\d+)*)(?:\s*,\s*Exposed\s+Pad\s+Pin\s+(\d+))?\)\s*:"
)
COMMON_WORDS = ["THE", "FOR", "AND", "WITH", "FROM", "THIS", "THAT", "NOTE", "TABLE", "FIGURE",
                "SEE", "WHEN", "PIN"]
GENERIC_NAMED = r"(?iU)Pin\s+(\d+)\s*[–\-:]\s*(\w+)"
GENERIC_LINE = r"(?md)^(\d+)\s+([A-Z][A-Z0-9_/]+)\s+(.*)$"
JUNK_NAMES = ["NATSISE", "CRUOS"]
FET_PINS = [("1", "G", "input", "Gate"), ("2", "S", "passive", "Source"), ("3", "D", "passive", "Drain")]
BJT_PINS = [("1", "C", "passive", "Collector"), ("2", "B", "input", "Base"),
            ("3", "E", "passive", "Emitter")]
