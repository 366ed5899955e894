"""Literal rows that reach every branch of the rules, for queries and their SQL alike."""

# Own literal fixtures: questions and sentences that reach each rule of the answer's choice.
RULE_QUERIES = ("跨境订单退款多久到账？", "SKU-A17 是否支持无理由退货？", "预售 48 小时没发货可以催单吗", "积分可以提现吗", "refund policy", "今天天气怎么样", "订单退款的天气险怎么算")
RULE_SENTENCES = (
    "审核通过后，到账时间通常为 7 到 15 个工作日。", "工作日内到账。", "超过 30 个工作日请联系客服。", "SKU-A17 不支持无理由退货。", "预售商品承诺 48 小时内发货。",
    "积分不能提现，也不能转赠。", "The refund policy is here.", "与此无关的一句话。",
)

# Own literal fixture: (query, coverage, selected, best score, lexical, ratio of what is blocked) for each outcome of the gate.
GATE_ROWS = (
    ("今天天气怎么样", 0.9, 3, 0.9, 1, None), ("refund", 0.0, 0, None, 0, 0.3), ("refund", 0.0, 0, None, 0, None), ("refund", 0.3, 2, 0.4, 1, 0.45),
    ("refund", 0.31, 2, 0.4, 1, 0.45), ("refund", 0.18, 1, 0.12, 1, None), ("refund", 0.1, 1, 0.35, 1, None), ("refund", 0.1, 1, 0.34, 1, None),
    ("refund", 0.9, 1, 0.11, 1, None), ("refund", 0.1, 2, 0.02, 0, None), ("refund", 0.1, 2, 0.02, 1, None), ("refund", 0.18, 2, 0.02, 0, 0.2), ("订单退款的天气险", 0.5, 1, 0.5, 1, None),
)

# Own literal documents.
GOLDEN_DOCS = (
    "---\ndoc_id: refunds\ntitle: 退款规则\npermission_scope: internal\n---\n\n# 退款规则\n\n## 跨境订单退款\n\n"
    "跨境订单退款要经过平台审核和渠道确认。审核通过后，到账时间通常为 7 到 15 个工作日。\n\n## 特殊商品退款\n\n"
    "SKU-A17 属于定制商品，不支持 7 天无理由退款。\n",
    "---\ndoc_id: members\ntitle: 会员规则\npermission_scope: internal\n---\n\n# 会员规则\n\n## 积分\n\n会员积分可以兑换优惠券，积分不能提现，也不能转赠。\n",
    "---\ndoc_id: finance\ntitle: 财务差异\npermission_scope: finance_restricted\n---\n\n## 差异工单\n\nFR-21 差异工单由财务共享中心处理。\n",
)
GOLDEN_QUERIES = (("q1", "跨境订单退款多久到账？"), ("q2", "SKU-A17 是否支持无理由退货？"), ("q3", "会员积分可以提现吗？"), ("q4", "今天北京天气怎么样？"), ("q5", "FR-21 差异工单怎么处理？"))
