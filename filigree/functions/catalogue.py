"""Fixed values of the filing domain: statement lines, concepts, items, families."""

from __future__ import annotations

# The candidate concepts of each statement line, in order of priority.
CONCEPTS: dict[str, str] = {
    "REVENUE": "RevenueFromContractWithCustomerExcludingAssessedTax RevenueFromContractWithCustomerIncludingAssessedTax Revenues SalesRevenueNet SalesRevenueGoodsNet SalesRevenueServicesNet InterestAndDividendIncomeOperating RealEstateRevenueNet RegulatedAndUnregulatedOperatingRevenue AdvertisingRevenue SubscriptionRevenue PremiumsEarnedNet",
    "COST_OF_REVENUE": "CostOfRevenue CostOfGoodsAndServicesSold CostOfGoodsSold CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization CostOfRevenueExcludingDepreciationDepletionAndAmortization CostOfGoodsSoldExcludingDepreciationDepletionAndAmortization CostOfServicesRevenue CostOfGoodsRevenue PolicyholderBenefitsAndClaimsIncurredNet",
    "GROSS_PROFIT": "GrossProfit",
    "RESEARCH_DEVELOPMENT": "ResearchAndDevelopmentExpense ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost ResearchAndDevelopmentExpenseSoftwareExcludingAcquiredInProcessCost",
    "SELLING_GENERAL_ADMIN": "SellingGeneralAndAdministrativeExpense GeneralAndAdministrativeExpense SellingAndMarketingExpense SellingExpense MarketingExpense AdministrativeExpense",
    "OPERATING_EXPENSES": "OperatingExpenses CostsAndExpenses NoninterestExpense OperatingCostsAndExpenses OtherOperatingIncomeExpenseNet",
    "OPERATING_INCOME": "OperatingIncomeLoss IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    "INTEREST_EXPENSE": "InterestExpenseNonOperating InterestExpense InterestExpenseDebt InterestAndDebtExpense InterestExpenseBorrowings",
    "PRETAX_INCOME": "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest IncomeLossFromContinuingOperationsBeforeIncomeTaxes IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    "TAX_EXPENSE": "IncomeTaxExpenseBenefit CurrentIncomeTaxExpenseBenefit DeferredTaxExpenseBenefit",
    "NET_INCOME": "NetIncomeLoss ProfitLoss NetIncomeLossAvailableToCommonStockholdersBasic IncomeLossFromContinuingOperations",
    "EPS_BASIC": "EarningsPerShareBasic",
    "EPS_DILUTED": "EarningsPerShareDiluted",
    "SHARES_BASIC": "WeightedAverageNumberOfSharesOutstandingBasic WeightedAverageNumberOfShareOutstandingBasicAndDiluted",
    "SHARES_DILUTED": "WeightedAverageNumberOfDilutedSharesOutstanding WeightedAverageNumberOfShareOutstandingBasicAndDiluted",
    "COMPREHENSIVE_INCOME": "ComprehensiveIncomeNetOfTax",
    "CASH": "CashAndCashEquivalentsAtCarryingValue Cash CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents CashAndDueFromBanks",
    "MARKETABLE_SECURITIES_CURRENT": "MarketableSecuritiesCurrent ShortTermInvestments AvailableForSaleSecuritiesCurrent AvailableForSaleSecuritiesDebtSecuritiesCurrent TradingSecuritiesCurrent",
    "ACCOUNTS_RECEIVABLE": "AccountsReceivableNetCurrent ReceivablesNetCurrent AccountsNotesAndLoansReceivableNetCurrent AccountsReceivableNet TradeAccountsReceivableNetCurrent ContractWithCustomerAssetNetCurrent",
    "INVENTORY": "InventoryNet InventoryFinishedGoodsNetOfReserves InventoryRawMaterialsAndSupplies InventoryWorkInProcessAndRawMaterialsNetOfReserves FinishedGoodsInventoryNet",
    "CURRENT_ASSETS": "AssetsCurrent",
    "PPE": "PropertyPlantAndEquipmentNet PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization PropertyPlantAndEquipmentGross PropertyPlantAndEquipmentNetIncludingFinanceLeaseRightOfUseAsset",
    "GOODWILL": "Goodwill",
    "INTANGIBLES": "FiniteLivedIntangibleAssetsNet IntangibleAssetsNetExcludingGoodwill",
    "OPERATING_LEASE_ASSETS": "OperatingLeaseRightOfUseAsset",
    "TOTAL_ASSETS": "Assets",
    "ACCOUNTS_PAYABLE": "AccountsPayableCurrent AccountsPayableAndAccruedLiabilitiesCurrent AccountsPayableTradeCurrent AccruedLiabilitiesCurrent",
    "CURRENT_LIABILITIES": "LiabilitiesCurrent AccountsPayableAccruedLiabilitiesCurrent ContractWithCustomerLiabilityCurrent",
    "DEBT_CURRENT": "ShortTermBorrowings ShortTermDebtCurrent LongTermDebtCurrent CurrentPortionOfLongTermDebt DebtCurrent FinanceLeaseLiabilityCurrent",
    "LONG_TERM_DEBT": "LongTermDebtNoncurrent LongTermDebt LongTermDebtAndFinanceLeaseObligations FinanceLeaseLiabilityNoncurrent",
    "OPERATING_LEASE_LIABILITIES": "OperatingLeaseLiability OperatingLeaseLiabilityCurrent OperatingLeaseLiabilityNoncurrent",
    "TOTAL_LIABILITIES": "Liabilities LiabilitiesAndTemporaryEquity LiabilitiesCurrentAndNoncurrent",
    "STOCKHOLDERS_EQUITY": "StockholdersEquity StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest PartnersCapital CommonStocksIncludingAdditionalPaidInCapital AccumulatedOtherComprehensiveIncomeLossNetOfTax",
    "RETAINED_EARNINGS": "RetainedEarningsAccumulatedDeficit RetainedEarnings AccumulatedDeficit",
    "LIABILITIES_AND_EQUITY": "LiabilitiesAndStockholdersEquity LiabilitiesAndPartnersCapital",
    "DEPRECIATION_AMORTIZATION": "DepreciationDepletionAndAmortization DepreciationDepletionAndAmortizationExpense DepreciationAndAmortization Depreciation AmortizationOfIntangibleAssets",
    "STOCK_BASED_COMPENSATION": "ShareBasedCompensation ShareBasedCompensationArrangementByShareBasedPaymentAwardExpense EmployeeServiceShareBasedCompensationNonvestedAwardsTotalCompensationCostNotYetRecognized",
    "CHANGE_RECEIVABLES": "IncreaseDecreaseInAccountsReceivable IncreaseDecreaseInReceivables IncreaseDecreaseInOperatingAssets",
    "CHANGE_INVENTORY": "IncreaseDecreaseInInventories IncreaseDecreaseInInventory",
    "CHANGE_PAYABLES": "IncreaseDecreaseInAccountsPayable IncreaseDecreaseInAccountsPayableAndAccruedLiabilities IncreaseDecreaseInOperatingLiabilities",
    "OPERATING_CASH_FLOW": "NetCashProvidedByUsedInOperatingActivities NetCashProvidedByUsedInOperatingActivitiesContinuingOperations NetCashProvidedByUsedInOperatingActivitiesContinuingAndDiscontinuedOperations",
    "CAPEX": "PaymentsToAcquirePropertyPlantAndEquipment PaymentsToAcquireProductiveAssets PaymentsToAcquirePropertyPlantAndEquipmentAndIntangibleAssets CapitalExpendituresIncurredButNotYetPaid",
    "ACQUISITIONS": "PaymentsToAcquireBusinessesNetOfCashAcquired PaymentsToAcquireBusinessesGross",
    "INVESTING_CASH_FLOW": "NetCashProvidedByUsedInInvestingActivities",
    "DIVIDENDS_PAID": "PaymentsOfDividends PaymentsOfDividendsCommonStock PaymentsOfOrdinaryDividends",
    "SHARE_REPURCHASES": "PaymentsForRepurchaseOfCommonStock PaymentsForRepurchaseOfEquity PaymentsForRepurchaseOfPreferredStockAndPreferenceStock",
    "DEBT_ISSUANCE": "ProceedsFromIssuanceOfLongTermDebt ProceedsFromBorrowings ProceedsFromIssuanceOfDebt ProceedsFromShortTermDebt",
    "DEBT_REPAYMENT": "RepaymentsOfLongTermDebt RepaymentsOfDebt PaymentsForRepurchaseOfDebt RepaymentsOfShortTermDebt",
    "FINANCING_CASH_FLOW": "NetCashProvidedByUsedInFinancingActivities",
    "CASH_CHANGE": "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect CashAndCashEquivalentsPeriodIncreaseDecrease",
    "ENDING_CASH": "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents CashAndCashEquivalentsAtCarryingValue CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsIncludingDisposalGroupAndDiscontinuedOperations",
}

# The lines of each statement in order, with their concept lists.
STATEMENTS: dict[str, list[tuple[str, str]]] = {
    "income": [
        ("revenue", "REVENUE"), ("cost_of_revenue", "COST_OF_REVENUE"), ("gross_profit", "GROSS_PROFIT"), ("research_and_development", "RESEARCH_DEVELOPMENT"),
        ("selling_general_admin", "SELLING_GENERAL_ADMIN"), ("operating_expenses", "OPERATING_EXPENSES"), ("operating_income", "OPERATING_INCOME"), ("interest_expense", "INTEREST_EXPENSE"),
        ("income_before_tax", "PRETAX_INCOME"), ("income_tax_expense", "TAX_EXPENSE"), ("net_income", "NET_INCOME"), ("eps_basic", "EPS_BASIC"),
        ("eps_diluted", "EPS_DILUTED"), ("shares_basic", "SHARES_BASIC"), ("shares_diluted", "SHARES_DILUTED"), ("comprehensive_income", "COMPREHENSIVE_INCOME"),
    ],
    "balance": [
        ("cash_and_equivalents", "CASH"), ("marketable_securities_current", "MARKETABLE_SECURITIES_CURRENT"), ("accounts_receivable", "ACCOUNTS_RECEIVABLE"), ("inventory", "INVENTORY"),
        ("current_assets", "CURRENT_ASSETS"), ("property_plant_equipment", "PPE"), ("goodwill", "GOODWILL"), ("intangible_assets", "INTANGIBLES"),
        ("operating_lease_assets", "OPERATING_LEASE_ASSETS"), ("total_assets", "TOTAL_ASSETS"), ("accounts_payable", "ACCOUNTS_PAYABLE"), ("current_liabilities", "CURRENT_LIABILITIES"),
        ("current_debt", "DEBT_CURRENT"), ("long_term_debt", "LONG_TERM_DEBT"), ("operating_lease_liabilities", "OPERATING_LEASE_LIABILITIES"), ("total_liabilities", "TOTAL_LIABILITIES"),
        ("stockholders_equity", "STOCKHOLDERS_EQUITY"), ("retained_earnings", "RETAINED_EARNINGS"), ("liabilities_and_equity", "LIABILITIES_AND_EQUITY"),
    ],
    "cashflow": [
        ("net_income", "NET_INCOME"), ("depreciation_amortization", "DEPRECIATION_AMORTIZATION"), ("stock_based_compensation", "STOCK_BASED_COMPENSATION"), ("change_receivables", "CHANGE_RECEIVABLES"),
        ("change_inventory", "CHANGE_INVENTORY"), ("change_payables", "CHANGE_PAYABLES"), ("operating_cash_flow", "OPERATING_CASH_FLOW"), ("capital_expenditures", "CAPEX"),
        ("acquisitions", "ACQUISITIONS"), ("investing_cash_flow", "INVESTING_CASH_FLOW"), ("dividends_paid", "DIVIDENDS_PAID"), ("share_repurchases", "SHARE_REPURCHASES"),
        ("debt_issuance", "DEBT_ISSUANCE"), ("debt_repayment", "DEBT_REPAYMENT"), ("financing_cash_flow", "FINANCING_CASH_FLOW"), ("cash_change", "CASH_CHANGE"),
        ("ending_cash", "ENDING_CASH"),
    ],
}

STATEMENT_NAMES = {"income": "income", "income_statement": "income", "balance": "balance", "balance_sheet": "balance", "cashflow": "cashflow", "cash_flow": "cashflow", "cash": "cashflow"}
STATEMENT_RANK = {"income": 0, "balance": 1, "cashflow": 2}

# Short names that stand for a concept list.
ALIASES: dict[str, str] = {
    "revenue revenues sales": "REVENUE",
    "costofrevenue costofsales cogs": "COST_OF_REVENUE",
    "grossprofit": "GROSS_PROFIT",
    "researchanddevelopment rd": "RESEARCH_DEVELOPMENT",
    "sga sellinggeneralandadministrative": "SELLING_GENERAL_ADMIN",
    "operatingexpenses": "OPERATING_EXPENSES",
    "operatingincome": "OPERATING_INCOME",
    "interestexpense": "INTEREST_EXPENSE",
    "pretaxincome incomebeforetax": "PRETAX_INCOME",
    "tax incometax": "TAX_EXPENSE",
    "netincome profit": "NET_INCOME",
    "assets totalassets": "TOTAL_ASSETS",
    "currentassets": "CURRENT_ASSETS",
    "cash": "CASH",
    "securities shortterminvestments": "MARKETABLE_SECURITIES_CURRENT",
    "receivables accountsreceivable": "ACCOUNTS_RECEIVABLE",
    "inventory": "INVENTORY",
    "ppe propertyplantandequipment": "PPE",
    "equity stockholdersequity": "STOCKHOLDERS_EQUITY",
    "liabilities totalliabilities": "TOTAL_LIABILITIES",
    "currentliabilities": "CURRENT_LIABILITIES",
    "retainedearnings accumulateddeficit": "RETAINED_EARNINGS",
    "debt longtermdebt": "LONG_TERM_DEBT",
    "currentdebt shorttermdebt": "DEBT_CURRENT",
    "operatingcashflow ocf": "OPERATING_CASH_FLOW",
    "capex capitalexpenditures": "CAPEX",
    "freecashflow": "OPERATING_CASH_FLOW",
}

# Official titles of the 8-K items.
EIGHTK_ITEMS: dict[str, str] = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "1.03": "Bankruptcy or Receivership",
    "1.04": "Mine Safety - Reporting of Shutdowns and Patterns of Violations",
    "1.05": "Material Cybersecurity Incidents",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Direct Financial Obligation",
    "2.04": "Triggering Events That Accelerate or Increase a Direct Financial Obligation",
    "2.05": "Costs Associated with Exit or Disposal Activities",
    "2.06": "Material Impairments",
    "3.01": "Notice of Delisting or Failure to Satisfy a Continued Listing Rule",
    "3.02": "Unregistered Sales of Equity Securities",
    "3.03": "Material Modification to Rights of Security Holders",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements",
    "5.01": "Changes in Control of Registrant",
    "5.02": "Departure or Appointment of Directors or Certain Officers",
    "5.03": "Amendments to Articles of Incorporation or Bylaws; Change in Fiscal Year",
    "5.04": "Temporary Suspension of Trading Under Registrant's Employee Benefit Plans",
    "5.05": "Amendments to Code of Ethics or Waiver of a Provision",
    "5.06": "Change in Shell Company Status",
    "5.07": "Submission of Matters to a Vote of Security Holders",
    "5.08": "Shareholder Director Nominations",
    "6.01": "ABS Informational and Computational Material",
    "6.02": "Change of Servicer or Trustee",
    "6.03": "Change in Credit Enhancement or Other External Support",
    "6.04": "Failure to Make a Required Distribution",
    "6.05": "Securities Act Updating Disclosure",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}

# Categories of the 8-K items by first digit.
EIGHTK_CATEGORIES = {
    "1": "business_and_operations", "2": "financial_information", "3": "securities_and_trading_markets", "4": "accountants_and_financial_statements", "5": "corporate_governance_and_management",
    "6": "asset_backed_securities", "7": "regulation_fd", "8": "other_events", "9": "financial_statements_and_exhibits",
}

# Topics of company tables with primary (2 points) and secondary (1 point) terms.
TOPICS: list[tuple[str, list[str], list[str]]] = [
    ("segment_revenue", ["segment", "reportable segment", "business segment"], ["revenue", "net sales", "sales"]),
    ("geographic_revenue", ["geographic", "country", "americas", "europe", "china", "japan"], ["revenue", "net sales", "sales"]),
    ("revenue_disaggregation", ["revenue by", "disaggregated revenue", "product", "service"], ["revenue", "net sales", "sales"]),
    ("debt_maturity", ["maturities", "long-term debt", "notes payable", "debt"], ["202", "thereafter", "principal", "interest"]),
    ("contract_obligations", ["contractual obligations", "purchase obligations", "commitments"], ["payments due", "thereafter", "operating lease"]),
    ("lease_maturity", ["lease", "leases", "right-of-use"], ["maturity", "thereafter", "future minimum"]),
    ("share_repurchases", ["repurchase", "share repurchase", "treasury stock"], ["shares", "amount", "average price"]),
    ("tax_rate", ["tax", "income tax", "effective tax"], ["rate", "benefit", "expense"]),
]

# Legal suffixes of company names.
LEGAL_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ltd", "limited", "lp", "l.p", "group", "del"]

# Auditors (patterns, first hit wins) and underwriters.
AUDITORS = [
    r"(Ernst\s*&\s*Young\s+LLP|EY\s+LLP)", r"(Deloitte\s*&\s*Touche\s+LLP|Deloitte\s+LLP)", r"(PricewaterhouseCoopers\s+LLP|PwC\s+LLP|PwC)", r"(KPMG\s+LLP)", r"(BDO\s+USA,\s+P\.?C\.?|BDO\s+LLP)",
    r"(Grant\s+Thornton\s+LLP)", r"(RSM\s+US\s+LLP)", r"(Mazars\s+USA\s+LLP)", r"(Marcum\s+LLP)", r"(Crowe\s+LLP)", r"(Baker\s+Tilly\s+US,\s+LLP)",
]
UNDERWRITERS = [
    "Morgan Stanley", "Goldman Sachs", "J.P. Morgan", "JP Morgan", "JPMorgan", "BofA Securities", "Merrill Lynch", "Barclays", "Citigroup", "Citi", "Deutsche Bank", "Evercore", "Jefferies", "RBC Capital Markets", "UBS",
    "Wells Fargo", "Credit Suisse", "BNP Paribas", "HSBC", "Nomura", "Mizuho", "Cowen", "Piper Sandler", "William Blair", "Stifel", "Raymond James", "Canaccord Genuity", "Needham", "Oppenheimer", "Baird",
]

# Form families with the record kind that each parser yields.
FORM_FAMILIES: list[tuple[str, str, list[str], str]] = [
    ("company_report", "10-K", ["10-K", "10-K/A", "10-Q", "10-Q/A"], "company_report"),
    ("form4", "4", ["3", "3/A", "4", "4/A", "5", "5/A"], "form4_transaction"),
    ("eight_k", "8-K", ["8-K", "8-K/A"], "eightk_event"),
    ("schedule13", "SC 13D", ["SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A"], "schedule13"),
    ("proxy", "DEF 14A", ["DEF 14A", "DEF 14A/A"], "proxy_statement"),
    ("prospectus", "S-1", ["S-1", "S-1/A", "F-1", "F-1/A", "424B", "424B1", "424B2", "424B3", "424B4", "424B5", "424B7"], "prospectus"),
    ("foreign_issuer", "20-F", ["20-F", "20-F/A", "6-K", "6-K/A", "40-F", "40-F/A"], "foreign_issuer"),
    ("fund_disclosure", "NPORT-P", ["NPORT-P", "NPORT-P/A", "N-PORT", "N-PORT/A", "N-CSR", "N-CSR/A", "N-CSRS", "N-CSRS/A", "N-CEN", "N-CEN/A", "N-PX", "N-PX/A", "497K", "497K/A", "24F-2NT", "24F-2NT/A"], "fund_disclosure"),
    ("thirteen_f", "13F-HR", ["13F-HR", "13F-HR/A", "13F-NT", "13F-NT/A"], "thirteenf_holding"),
]


def concepts_of(name: str) -> list[str]:
    return CONCEPTS[name].split()


def alias_concepts(query: str) -> list[str] | None:
    """Concepts of a known short name, after its last colon and without punctuation; None if unknown."""
    key = "".join(c for c in query.rsplit(":", 1)[-1] if c.isascii() and c.isalnum()).lower()
    return next((concepts_of(v) for k, v in ALIASES.items() if key in k.split()), None)


def statement_lines(statement: str = "all") -> list[tuple[str, int, str, str, int]]:
    """(statement, line_order, line_item, concept, priority) rows of one statement or all."""
    wanted = statement.strip().lower().replace("-", "_")
    if wanted != "all" and wanted not in STATEMENT_NAMES:
        raise ValueError(f"unsupported statement {statement!r}")
    return [
        (name, order, item, concept, priority)
        for name, lines in STATEMENTS.items()
        if wanted == "all" or STATEMENT_NAMES[wanted] == name
        for order, (item, key) in enumerate(lines, 1)
        for priority, concept in enumerate(concepts_of(key))
    ]
