"""A small shop: a controller, a service behind an interface, mappers, queues, caches and clients."""

from ripplegraph.plans.engine import facts_of

P = "shop"


def build(spark):
    classes, methods, calls, args, exprs, variables, notes, supers, overrides = [], [], [], [], [], [], [], [], []

    def cls(fqn, kind="class", params=(), source=True, project=P):
        classes.append((project, fqn, fqn.rsplit(".", 1)[-1], kind, False, False, list(params), source))

    def method(key, text="", params=(), returns="void", modifiers=("public",), stmts=("x();", "y();"), source=True, project=P):
        fqn, name = key.rsplit("#", 1)
        methods.append((project, key, fqn, name, list(params), returns, list(modifiers), text, None if stmts is None else list(stmts), source, len(methods)))

    def call(caller, callee, text="", kind="call", ref="", qualifier=None, qtype=None, qargs=None, arguments=()):
        cid = f"call{len(calls)}"
        calls.append((P, cid, caller, len(calls), kind, callee, ref, text, qtype, qargs, qualifier))
        for pos, (expr, type_fqn, type_args) in enumerate(arguments):
            args.append((cid, pos, expr, type_fqn, type_args))

    def expr(eid, kind, text="", const=None, ref=None, operands=()):
        exprs.append((eid, kind, text, const, ref, list(operands)))

    def note(kind, target, short, fqn=None, **attrs):
        a = {k: [v] for k, v in attrs.items()}
        notes.append((P, kind, target, len(notes), fqn or f"x.{short}", short, a, a, {k: v for k, v in attrs.items()}))

    for c in ("a.OrderController", "a.OrderServiceImpl", "a.OtherServiceImpl", "a.Order", "a.Consumer", "a.Producer", "a.Util", "a.PriceClient", "a.Http"):
        cls(c)
    cls("a.OrderService", "interface")
    cls("a.OrderMapper", "interface")
    cls("a.Dao", "interface")
    cls("a.BillClient", "interface")
    cls("org.springframework.data.redis.RedisTemplate", source=False)
    cls("org.springframework.kafka.core.KafkaTemplate", source=False)
    cls("org.springframework.web.client.RestTemplate", source=False)
    cls("java.util.List", source=False)
    cls("com.baomidou.BaseMapper", "interface", params=("T",), source=False)
    supers += [(P, "a.OrderServiceImpl", "a.OrderService", [], 0), (P, "a.OtherServiceImpl", "a.OrderService", [], 0), (P, "a.Dao", "com.baomidou.BaseMapper", ["a.Order"], 0)]
    method("a.OrderController#save", "save(){}")
    note("class", "a.OrderController", "RequestMapping", value="/api/order")
    note("method", "a.OrderController#save", "PostMapping", value="save")
    method("a.OrderController#list")
    note("method", "a.OrderController#list", "GetMapping", value="/list")
    method("a.OrderController#list2")
    note("method", "a.OrderController#list2", "GetMapping", value="list")
    method("a.OrderService#save", modifiers=("public", "abstract"), stmts=None)
    method("a.OrderServiceImpl#save")
    method("a.OtherServiceImpl#save")
    overrides += [("a.OrderService#save", "a.OrderServiceImpl#save"), ("a.OrderService#save", "a.OtherServiceImpl#save")]
    variables.append(("f:svc", "field", "svc", "a.OrderController", "a.OrderService", None, 0))
    note("class", "a.OrderServiceImpl", "Service", value="main")
    note("field", "f:svc", "Resource", name="main")
    call("a.OrderController#save", "a.OrderService#save", qualifier="f:svc")
    call("a.OrderController#save", None, text="mystery()")
    call("a.OrderController#save", None, kind="ref", ref="new", text="Order::new")
    method("a.OrderMapper#insertOrder", stmts=None, modifiers=("public", "abstract"))
    call("a.OrderServiceImpl#save", "a.OrderMapper#insertOrder")
    method("com.baomidou.BaseMapper#selectById", source=False, stmts=None, modifiers=("abstract",))
    note("class", "a.Order", "TableName", value="t_order")
    call("a.OrderServiceImpl#save", "com.baomidou.BaseMapper#selectById", qtype="a.Dao", arguments=[("e:long", "java.lang.Long", [])])
    expr("e:long", "literal", "1L")
    method("org.springframework.data.redis.RedisTemplate#getKey", source=False)
    expr("e:key", "literal", '"order:1"', "order:1")
    call("a.OrderServiceImpl#save", "org.springframework.data.redis.RedisTemplate#getKey", arguments=[("e:key", "java.lang.String", [])])
    method("org.springframework.kafka.core.KafkaTemplate#send", source=False)
    variables.append(("f:topic", "field", "topic", "a.OrderServiceImpl", "java.lang.String", None, 1))
    note("field", "f:topic", "Value", value="${mq.order.topic}")
    expr("e:topic", "ref", "topic", None, "f:topic")
    call("a.OrderServiceImpl#save", "org.springframework.kafka.core.KafkaTemplate#send", arguments=[("e:topic", "java.lang.String", [])])
    method("a.Consumer#onOrder")
    note("method", "a.Consumer#onOrder", "KafkaListener", topics="${mq.order.topic}")
    note("method", "a.Consumer#onOrder", "Cacheable", value="orders")
    method("a.Consumer#onOther")
    note("method", "a.Consumer#onOther", "KafkaListener", topics="${mq.other.topic}")
    method("a.Http#call")
    call("a.Consumer#onOrder", "a.Http#call")
    method("org.springframework.web.client.RestTemplate#postForObject", source=False)
    variables.append(("f:host", "field", "host", "a.Http", "java.lang.String", None, 0))
    note("field", "f:host", "Value", value="${pay.host}")
    variables.append(("l:u", "local", "u", "a.Http", "java.lang.String", "e:cat", 0))
    expr("e:host", "ref", "host", None, "f:host")
    expr("e:path", "literal", '"/pay"', "/pay")
    expr("e:cat", "polyadic", "host + path", None, None, ["e:host", "e:path"])
    expr("e:u", "ref", "u", None, "l:u")
    call("a.Http#call", "org.springframework.web.client.RestTemplate#postForObject", arguments=[("e:u", "java.lang.String", [])])
    note("class", "a.BillClient", "FeignClient", name="bill-svc", path="/bill")
    method("a.BillClient#query", stmts=None, modifiers=("abstract",))
    note("method", "a.BillClient#query", "GetMapping", value="/get-one")
    call("a.Http#call", "a.BillClient#query")
    method("java.util.List#add", source=False)
    call("a.Http#call", "java.util.List#add")
    method("a.Order#getId", returns="long", stmts=("return id;",))
    variables.append(("f:id", "field", "id", "a.Order", "long", None, 0))
    call("a.Http#call", "a.Order#getId")
    call("a.Http#call", "a.OrderController#save")
    bill = "bill"
    cls("b.BillController", project=bill)
    method("b.BillController#one", project=bill)
    note("class", "b.BillController", "RequestMapping", value="/bill")
    note("method", "b.BillController#one", "GetMapping", value="get-one")
    mapper = "<mapper namespace='a.OrderMapper'><sql id='t'>order_log</sql><insert id='insertOrder'>insert into <include refid='t'/> (id) values (#{id})</insert></mapper>"
    given = {
        "project": [(P, "/p/shop", True, False), (bill, "/p/bill", True, False)],
        "src_class": classes, "supertype": supers, "method": methods, "call_site": calls, "call_arg": args, "expr": exprs, "variable": variables, "annotation": notes, "override": overrides,
        "method_span": [(P, "A.java", "a.Http#call", 10, 20), (P, "A.java", "a.Order#getId", 30, 40)],
        "config_file": [(P, 0, "a.properties", "pay.host=http://old"), (P, 1, "b.yml", "pay:\n  host: http://${pay.name:pay}\n  name: 'pay.local'\n")],
        "mapper_file": [(P, "m.xml", mapper), (P, "bad.xml", "<mapper")],
    }
    return facts_of(spark, given)
