from codeloom.operators.overlay import overlay
from codeloom.sources import robotics

ROBOT = '''
class Arm(LifecycleNode):
    def __init__(self):
        super().__init__("")
        super().__init__("arm")
        other.create_publisher(M, "/no")
        self.create_publisher(pkg.M, "/a", 10)
        self.create_publisher(M, topic)
        self.create_subscription(list[M], "/b", lambda m: m)
        ActionClient(self, Go, "go"); ActionServer(self, Go, "go"); x.ActionServer(self, Go, "no")

    class Inner(Node):
        pass

class Plain(Base): pass

if True:
    class Late(rclpy.node.Node):
        def f(self): self.declare_parameter("p")
'''


def test_node_classes():
    arm, late = robotics.robots_of(ROBOT)
    assert (arm["class_name"], arm["node_name"], late["class_name"], late["node_name"]) == ("Arm", "arm", "Late", None)
    assert [(e["kind"], e["name"], e["type"], e["detail"]) for e in arm["entries"]] == [
        ("publisher", "/a", "M", None), ("subscriber", "/b", "list[M]", "lambda m: m"), ("action_client", "go", "Go", None), ("action_server", "go", "Go", None)]
    assert late["entries"] == [{"kind": "parameter", "name": "p", "type": None, "detail": None}]
    assert robotics.robots_of(None) == robotics.robots_of("def (") == robotics.robots_of("\0") == []


def test_launch_needs_its_function():
    call = "Node(package='p', executable=exe, parameters=x, remappings=[('a', b)])"
    assert robotics.launch_of(call) == ([], []) == robotics.launch_of(None)
    nodes, arguments = robotics.launch_of(f"async def generate_launch_description(): pass\nLD([{call}, a.DeclareLaunchArgument('q'), DeclareLaunchArgument(n)])")
    assert nodes == [{"package": "p", "executable": "exe", "name": None, "parameters": [], "remappings": []}] and arguments == ["q"]


def test_first_declaration_last_class(spark):
    files = spark.createDataFrame([("/b.py", 2, "class A(Node):\n def f(self): self.create_publisher(Y, '/t'); self.create_service(S, 's')"), ("/a.py", 1, "class A(Node):\n def f(self): self.create_publisher(X, '/t')"), ("/c.py", 3, None)], "file_path string, ordinal long, source string")
    g = overlay(robotics.robots(files))
    assert {(r.id, r.file_path, r.msg_type) for r in g.nodes.collect()} == {("ros2_node::A", "/b.py", None), ("topic::/t", "/a.py", "X"), ("service::s", "/b.py", "S")}
    assert {(r.id, r.edge_type) for r in g.edges.collect()} == {("pub::ros2_node::A::topic::/t", "PUBLISHES_TO"), ("svc::ros2_node::A::service::s", "PROVIDES_SERVICE")}


def test_definitions_of_odd_files(spark):
    files = spark.createDataFrame([("/x/A.srv", "int8 a = # none\n---\nint8 b=1=2"), ("B.msg", "int8 a\n---\nint8 b"), ("C.txt", "int8 a"), ("D.msg", None), ("E.action", "")], "file_path string, source string")
    got = {(r.name, r.section, r.field_name, r.default_value) for r in robotics.definitions(files).collect()}
    assert got == {("A", "request", "a", None), ("A", "response", "b", "1=2"), ("B", "fields", "a", None), ("B", "fields", "b", None)}
